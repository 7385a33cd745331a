"""Operators for preparing training text: one module for each operator.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
