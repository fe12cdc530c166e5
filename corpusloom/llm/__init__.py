"""Operators for building language-model training corpora.

Nothing else in the library imports this subpackage.
"""
