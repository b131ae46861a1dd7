"""The operators of the algebra, each a composition of DataFrame operations."""
