"""Package-catalog analytics as Spark DataFrame operators."""
