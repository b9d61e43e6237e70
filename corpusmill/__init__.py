"""A Spark-first engine for building and querying a text-retrieval corpus."""
