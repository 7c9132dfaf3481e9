"""Operators of a training-data pipeline over a table of documents.

Each module is one operator with a general interface (any id and text column) and real outputs; ``plans.py``
registers one query per operator. Nothing outside this package imports it.
"""
