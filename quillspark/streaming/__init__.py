"""Structured Streaming: rate limits with state, the ingest queue, windowed usage."""
