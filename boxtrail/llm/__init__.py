"""Operators of a large-scale training-data pipeline, one module each.

Nothing outside this package imports it; ``queries.py`` lists what it offers.
"""
