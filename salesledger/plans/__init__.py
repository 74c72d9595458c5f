"""Whole pipelines: prepare, export and close."""
