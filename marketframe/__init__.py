"""marketframe: market time-series analytics as Spark DataFrame operators."""
