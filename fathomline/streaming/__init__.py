"""Structured Streaming over the event and message tables."""
