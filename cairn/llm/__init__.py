"""Operators that prepare data for training language and ranking models. Nothing outside imports this package."""
