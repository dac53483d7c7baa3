"""Queries over the plans, for tables that stand in for files."""
