"""Incremental event jobs with Structured Streaming."""
