"""DataFrame operators: features, labels, table operations, buckets, splits, search."""
