"""Structured Streaming of position fixes."""
