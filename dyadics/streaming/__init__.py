"""Structured Streaming jobs: completion of both perspectives, idempotent ingest, running summaries."""
