"""Operators for training-data pipelines over text, pages, conversations and vectors."""
