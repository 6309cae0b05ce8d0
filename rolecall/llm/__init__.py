"""Operators for preparing training data at scale; see README. Nothing else in the library imports this package."""
