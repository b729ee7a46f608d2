"""Operators for training-data preparation on documents and vectors."""
