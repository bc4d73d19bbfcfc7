"""Structured Streaming forms of ingestion and indexing."""
