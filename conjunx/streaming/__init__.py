"""Queries over tables that grow."""
