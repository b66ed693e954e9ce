"""Structured Streaming: the task stream."""
