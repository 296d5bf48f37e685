"""Structured Streaming jobs whose results equal the batch operators."""
