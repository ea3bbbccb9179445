"""Event-log and Structured Streaming jobs."""
