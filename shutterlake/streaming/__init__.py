"""Structured Streaming forms of ingest and trips."""
