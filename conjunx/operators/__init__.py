"""The relational operators: scans, joins, projection, order, duplicates."""
