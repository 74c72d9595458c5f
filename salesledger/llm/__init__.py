"""Operators for training data: each module holds one operator on DataFrames and is imported on its own."""
