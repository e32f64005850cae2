"""Readers for the text layouts and the sinks."""
