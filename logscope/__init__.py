"""Log analytics on Spark: entries, runs and reports as DataFrame operators."""
