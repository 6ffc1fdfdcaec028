"""Repository events: batch core and Structured Streaming wrappers."""
