"""Connected components as DataFrame rounds over edge tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Edges that a task contracts at once.
CHUNK = 1 << 17


def _contracted(rows: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """For each run of about `chunk` edges, its nodes with the smallest node that the run joins them to."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    def stars() -> pa.RecordBatch:
        found = [(x, find(x)) for x in root]
        found = [x for x in found if x[0] != x[1]]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["hi", "lo"])

    n = 0
    for batch in rows:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        n += len(batch)
        if n >= chunk:
            yield stars()
            root.clear()
            n = 0
    if root:
        yield stars()


def components(edges: DataFrame, most: int = 60, chunk: int = CHUNK) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node that each reaches.

    Edges are contracted in runs of about `chunk`, each in one task; if one run held them all, it is done. Else follows
    a round of large-star and small-star contraction, which points each node's neighbours at the smallest of them, and
    what it leaves is contracted again, until no node points at two, or at one that points on. Loops, repeated edges
    and either direction are allowed; nulls join nothing. No group is ever gathered: a round is minima by key and
    joins, so a hub of any degree is combined before the shuffle and split by adaptive execution after it.
    """
    left = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    for _ in range(most):
        # Written before it is contracted, so that few tasks read edges, but many find them.
        left = written(left, "edges")
        runs = max(1, -(-left.count() // chunk))
        e = left.coalesce(runs).mapInArrow(partial(_contracted, chunk=chunk), "hi long, lo long")
        e = written(e if runs == 1 else e.distinct(), "stars")
        if runs == 1:
            break
        n, heads = e.agg(F.count("*"), F.count_distinct("hi")).first()
        if n == heads and e.join(e.select(F.col("hi").alias("lo")), "lo", "left_semi").head() is None:
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        # Both sides of a join are plain shuffles of tables, so that a hub's rows are split.
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
        low = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "low")
        moved = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        left = moved.union(low.select("hi", F.col("m").alias("lo"))).distinct().toDF("a", "b")
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo").distinct())
