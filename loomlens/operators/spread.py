"""Dealing out rows of a table that is stored in fewer pieces than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """df as it is where its scan fills the cores; else dealt by key, once, before work that takes longer than the move.
    A large table has more pieces than cores and never moves. A small file's pieces are cut by bytes, not by its row
    groups, so most of them may be empty; up to a piece for each core counts as too few."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df._jdf.queryExecution().toRdd().getNumPartitions() <= cores else df
