"""Readers, cleaners, audits and sinks."""
