"""Operators for large training-text collections; nothing else in the library imports them."""
