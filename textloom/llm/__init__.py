"""Operators for preparing training data at scale.

Nothing else in the package imports this subpackage; it can be deleted whole.
"""
