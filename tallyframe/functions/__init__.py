"""Rules about paths, versions and sizes, as columns and as plain functions."""
