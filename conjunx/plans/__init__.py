"""Queries before they are DataFrames: model, dialect, rewrites, join order, text."""
