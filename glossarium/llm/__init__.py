"""Operators for large-scale training-data preparation, one module each.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin
``opN_*`` queries and their SQL.
"""
