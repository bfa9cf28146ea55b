"""Corpus operators for training data; nothing else in the library imports this package."""
