"""Queries over the tables of a folder, and the SQL that says the same."""
