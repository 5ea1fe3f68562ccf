"""Operators for training-data preparation; nothing outside this package imports it."""
