"""Sparse linear algebra and training-data operators, expressed as Spark DataFrame plans."""
