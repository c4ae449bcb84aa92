"""Linkage plans: fixtures over star-schema tables, the catalogue of queries, and the flagship."""
