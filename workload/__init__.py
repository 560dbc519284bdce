"""The registered queries, their inputs made from the given tables, and their SQL."""
