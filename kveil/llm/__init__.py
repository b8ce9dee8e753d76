"""Operators for preparing training data at scale. Nothing outside this package imports it."""
