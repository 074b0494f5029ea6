"""Structured Streaming jobs that agree with the batch operators."""
