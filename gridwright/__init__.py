"""Spark jobs for utility-network data quality: rules, joins, traces, comparisons and catalogs."""
