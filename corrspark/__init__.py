"""Linking two text corpora at scale, as Spark jobs."""
