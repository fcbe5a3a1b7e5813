"""Operators that prepare training text at scale. Nothing outside this package imports it."""
