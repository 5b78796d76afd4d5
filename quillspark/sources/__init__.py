"""Corpus readers and sinks."""
