"""Operators for preparing text to train language models on. Nothing outside this package imports it."""
