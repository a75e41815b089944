"""Operators for large training-text tables.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; the thin ``opN_<name>`` queries live in ``queries.py``.
"""
