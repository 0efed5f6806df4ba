"""Plans: test registry, named query catalog and the DuckDB oracle text."""
