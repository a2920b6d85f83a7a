"""Analytics over adaptive multi-resolution volumes with Spark."""
