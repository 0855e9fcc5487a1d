"""Operators for large-scale training-data pipelines, as Spark DataFrame transformations."""
