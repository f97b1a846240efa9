"""Reusable DataFrame operators: scratch tables, row numbers, lookups, model calls."""
