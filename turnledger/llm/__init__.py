"""Operators for building language-model training corpora.

The subpackage stands alone: nothing outside it imports it, and it imports
nothing from the rest of the library.
"""
