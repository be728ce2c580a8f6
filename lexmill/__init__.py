"""lexmill: a Spark-first engine for deterministic text-corpus analytics."""
