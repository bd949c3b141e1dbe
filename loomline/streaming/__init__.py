"""Structured Streaming jobs; transformations are shared with the batch jobs."""
