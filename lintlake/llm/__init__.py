"""Operators for training data: everything here is optional, nothing else in the library imports it."""
