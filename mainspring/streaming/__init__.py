"""Records in Structured Streaming."""
