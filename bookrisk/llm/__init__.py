"""Operators of a training-data pipeline over ``documents`` and ``pages``.

Nothing else in the library imports this subpackage. Each module is one
operator with its own interface; ``queries.py`` holds the registered queries.
"""
