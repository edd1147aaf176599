"""The operators applied to the given tables, with SQL to check them."""
