"""Operators for large training corpora: scoring, search, deduplication, tokenizing, packing.

Nothing outside this folder imports it.  Every operator takes and returns DataFrames; numpy runs inside tasks
on Arrow batches that Spark has partitioned.
"""
