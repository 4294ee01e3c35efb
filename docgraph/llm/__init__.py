"""Operators of a training-data pipeline, on Spark DataFrames.

Nothing outside this subpackage imports it.  ``queries.QUERIES`` and
``queries.ORACLE_SQL`` hold the registered queries.
"""
