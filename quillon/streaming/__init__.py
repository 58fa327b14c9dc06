"""Stateful processing and sinks."""
