"""Operators of a training-data pipeline: tokenizing, filtering, near-duplicates, mixing.

Nothing else in the library imports this subpackage. ``turnstone.llm.catalog``
holds the named queries and their SQL.
"""
