"""Queries that show every operator on the synthetic tables, each with SQL to check it."""
