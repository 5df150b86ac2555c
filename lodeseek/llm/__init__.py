"""Operators that prepare training text and code. Nothing else in the library imports this package."""
