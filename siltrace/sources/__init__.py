"""Readers, writers, generators and checks of input tables."""
