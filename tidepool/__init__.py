"""Analytics over the catalogue of a deduplicating, content-addressed object store, in plain Spark."""
