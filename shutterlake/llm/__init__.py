"""Operators for training data from texts; nothing else in the library imports this subpackage."""
