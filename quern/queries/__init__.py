"""Registered queries over the given tables, with the same query as SQL where SQL can express it."""
