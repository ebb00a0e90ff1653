"""Operators for large text-training corpora."""
