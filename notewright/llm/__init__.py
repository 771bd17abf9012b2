"""Operators for preparing training text: one module an operator, its query beside it."""
