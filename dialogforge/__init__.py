"""dialogforge: Spark operators for multi-turn dialogue data sets."""
