"""Readers and writers of the files the pipelines exchange."""
