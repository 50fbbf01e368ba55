"""Structured Streaming forms: exactly-once ingestion and running entity heads."""
