"""Contest analytics on Spark: ratings, as-of history, features, models and reports."""
