"""Operators for large training-data pipelines (one module per operator).

Each module holds the general operator and the thin ``opN`` query that applies
it to a whole table. Nothing outside this folder imports it.
"""
