"""Queries over the test tables, each with the SQL it is held against."""
