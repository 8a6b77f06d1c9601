"""Adapters from general tables, and the registered queries with their SQL."""
