"""Column expressions. Everything here is row-local: no shuffle, no Python in the tasks."""
