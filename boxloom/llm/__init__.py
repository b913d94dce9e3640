"""Operators for training-data corpora. Nothing else in boxloom imports this package."""
