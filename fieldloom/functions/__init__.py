"""Scalar expressions and small dimension tables."""
