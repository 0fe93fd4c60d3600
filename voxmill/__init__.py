"""A Spark engine for three-dimensional volumes."""
