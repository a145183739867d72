"""sedimenta: a Spark-first engine for occurrence-evidence analytics."""
