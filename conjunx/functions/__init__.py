"""Column expressions of the dialect's predicates."""
