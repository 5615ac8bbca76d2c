"""Operators for large training-corpus pipelines; nothing outside imports this."""
