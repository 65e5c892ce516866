"""Operators for training-data pipelines, each one a function from DataFrame to DataFrame."""
