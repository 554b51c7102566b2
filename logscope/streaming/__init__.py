"""Followed files, sessions and snapshots with Structured Streaming."""
