"""Corpus preparation for language-model training: DataFrame operators.

Nothing else in the library imports this subpackage.
"""
