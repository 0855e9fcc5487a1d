"""Sparse linear-algebra operators over Vector and matrix frames."""
