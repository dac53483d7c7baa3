"""A PySpark engine for reconciling file manifests."""
