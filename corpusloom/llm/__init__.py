"""Operators for large training-data pipelines.

Nothing else in the package imports this subpackage; deleting it leaves the
rest of the library intact.
"""
