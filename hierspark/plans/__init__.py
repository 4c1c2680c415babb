"""The operators bound to the given tables, and the SQL that checks them."""
