"""Operators for training-data pipelines on Spark."""
