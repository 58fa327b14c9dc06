"""Datasets with versions."""
