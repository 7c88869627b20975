"""Continuous queries on Structured Streaming sources."""
