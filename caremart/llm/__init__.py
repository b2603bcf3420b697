"""Operators of a training-data pipeline: text, token and vector tables.

Nothing else in the library imports this package.  Every module holds one
operator with its own general interface; ``queries`` registers the thin
``opN_<name>`` queries over the given tables.
"""
