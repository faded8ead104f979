"""Operators for preparing language-model training corpora.

Nothing else in the library imports this package; ``queries.py`` holds the
registered queries and their SQL.
"""
