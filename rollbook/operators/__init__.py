"""Reusable DataFrame operators: filters, joins, keyed rows, ordered rows, intervals, snapshots."""
