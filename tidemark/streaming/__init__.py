"""Structured Streaming forms of the keyed stateful operators."""
