"""Rule-driven page extraction and reading analytics as Spark jobs."""
