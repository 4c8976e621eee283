"""Analytics over personal status event streams, written for Spark's DataFrame API."""
