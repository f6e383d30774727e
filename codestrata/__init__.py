"""codestrata: source repositories as DataFrames, analysed with Spark."""
