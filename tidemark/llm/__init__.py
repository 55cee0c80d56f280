"""Operators that prepare language-model training data, each a DataFrame transformation.

Nothing outside this subpackage imports it.
"""
