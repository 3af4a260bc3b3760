"""Feature-by-sample count analytics as lazy Spark DataFrame operators."""
