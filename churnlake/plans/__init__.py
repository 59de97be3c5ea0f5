"""Query catalog: Spark plans per operator and their DuckDB oracles."""
