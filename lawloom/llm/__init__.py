"""Operators for training data; optional, and not imported by the rest of the library."""
