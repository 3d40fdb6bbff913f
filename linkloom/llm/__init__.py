"""Operators of a training-data pipeline over large document tables.

Nothing outside this folder imports it.  Every operator takes and returns DataFrames;
the thin contract queries are in :mod:`linkloom.llm.queries`.
"""
