"""A Spark-first engine for biological sequence columns."""
