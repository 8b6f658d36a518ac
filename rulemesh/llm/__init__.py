"""Operators for preparing large text corpora.

Nothing else in the library imports this subpackage; ``queries.py`` lists its
queries and their SQL.
"""
