"""Operators for preparing training data.  Nothing else in the package imports this."""
