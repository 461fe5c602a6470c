"""Scalar expressions and vectorised functions."""
