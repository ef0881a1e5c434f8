"""Semantic hashing, retrieval and codebook deduplication as Spark jobs."""
