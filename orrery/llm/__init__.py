"""Operators for preparing training text: one module for each of them, queries in ``registry``."""
