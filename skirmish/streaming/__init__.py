"""Structured Streaming forms of the ingest loop (L1, L2) via ``foreachBatch``."""
