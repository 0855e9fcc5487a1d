"""Iterative solvers, and the bindings of the test tables."""
