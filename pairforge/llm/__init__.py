"""Operators for training-data pipelines, their queries and check SQL."""
