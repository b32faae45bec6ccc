"""Operators for building training text; nothing else in the library imports them."""
