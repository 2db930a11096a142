"""Windows over a live series, with Structured Streaming."""
