"""Readers, cleaning and table sinks."""
