"""The stateless and windowed jobs on Structured Streaming."""
