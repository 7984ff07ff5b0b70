"""Operators for preparing text collections as training data. Nothing outside this package imports it."""
