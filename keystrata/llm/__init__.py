"""Operators for preparing training text.  Nothing else in keystrata imports this package."""
