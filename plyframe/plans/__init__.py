"""Plan shapes shared by several operators."""
