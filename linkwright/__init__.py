"""Catalog search and fuzzy record linkage as Spark jobs."""
