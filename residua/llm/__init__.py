"""Operators for preparing language-model training text, one module per operator.

Nothing else in the package imports this subpackage.
"""
