"""Operators for building language-model training corpora from a documents table.

Nothing else in the library imports this package.
"""
