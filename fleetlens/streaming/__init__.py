"""Structured Streaming over run journals."""
