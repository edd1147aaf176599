"""The per-request rules restated for Structured Streaming."""
