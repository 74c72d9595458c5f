"""Tests of the operators for training data."""
