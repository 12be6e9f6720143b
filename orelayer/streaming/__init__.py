"""Structured Streaming: incremental landing, duplicate-safe landing, change capture."""
