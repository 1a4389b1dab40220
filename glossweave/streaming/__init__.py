"""Structured Streaming forms of the event and memory operators."""
