"""Operators for training-data pipelines, each with a registered query."""
