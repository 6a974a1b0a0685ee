"""Operators of a training-data pipeline: quality rules, language identification, near-duplicate
join, substring removal, HTML extraction, packing, mixing, exact top-k search, license scans and
sharding. Nothing outside this subpackage imports it.

Every operator takes DataFrames and parameters and returns DataFrames. Inputs may hold nulls in any
column, empty and very long texts, repeated rows, no rows, and extra columns: operators select the
columns they need first, so names of extra columns never clash with working columns.
"""
