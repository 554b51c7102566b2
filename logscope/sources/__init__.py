"""Readers and generators of log lines."""
