"""Operators for training data. Nothing outside this sub-package imports it."""
