"""Structured Streaming versions of the timelines."""
