"""Operators for training-data preparation; nothing outside imports this package."""
