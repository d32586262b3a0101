"""Usage analytics over append-only transcript logs, on Spark."""
