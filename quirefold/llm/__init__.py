"""Operators that prepare text and tags for training. Nothing else in the library imports this package."""
