"""Foliant: retrieval and analytics over document corpora, as Spark jobs."""
