"""Structured Streaming surface."""
