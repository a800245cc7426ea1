"""The scheduled runs as Structured Streaming queries."""
