"""Operators for preparing training text. Nothing else in tagstream imports this package."""
