"""Relational operators: contracts, cohort filters, joins, reshaping, matching, weights, metrics."""
