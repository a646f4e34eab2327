"""Operators for preparing language-model training data.

Ten operators that stand apart from the rest of the library: nothing outside this
subpackage imports it, and the folder may be removed without touching the others.
"""
