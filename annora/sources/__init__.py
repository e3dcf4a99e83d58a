"""Reading vectors, and the versioned Parquet store of an index."""
