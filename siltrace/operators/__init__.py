"""Wafer analytics operators over DataFrames."""
