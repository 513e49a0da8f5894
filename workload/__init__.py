"""The operators applied to the given tables, with SQL for the same results."""
