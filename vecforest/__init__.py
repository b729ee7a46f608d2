"""Semantic document forests on Spark."""
