"""Readers, names and sinks."""
