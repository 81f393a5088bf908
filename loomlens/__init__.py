"""Corpus analytics on Spark: scans, parsing, indexing and structural queries as DataFrames."""
