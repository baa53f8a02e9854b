"""Corpus sources and sinks."""
