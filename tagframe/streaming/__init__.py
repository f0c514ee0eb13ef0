"""Structured Streaming entry points for the per-row and per-document operators."""
