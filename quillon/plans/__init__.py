"""Composite queries."""
