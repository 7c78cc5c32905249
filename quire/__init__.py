"""A literature library as DataFrames: chunks, vectors, a typed graph, and retrieval over them."""
