"""Structured Streaming forms of the operators whose input keeps arriving."""
