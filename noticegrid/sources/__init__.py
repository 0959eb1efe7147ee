"""Readers of landed raw data, the source registry and the report sinks."""
