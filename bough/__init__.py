"""Analytics over immutable, content-addressed snapshots, on Spark."""
