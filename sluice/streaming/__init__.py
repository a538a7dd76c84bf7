"""Structured Streaming jobs (file auto-load)."""
