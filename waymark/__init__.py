"""A Spark engine for geographic tables: build, search, reverse geocoding and viewport queries."""
