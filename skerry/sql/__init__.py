"""The engine's own SQL dialect, translated to Spark SQL."""
