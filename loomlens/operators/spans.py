"""Intervals of lines: containment, overlap, union, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Lines of a block, by which points and spans of one key are brought together.
BLOCK = 64


def enclosing(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """The deepest span (key, start, stop, depth, name) around each point (key, line); the first on a tie. Points meet the
    spans of their block of lines only."""
    cut = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor(F.greatest("start", "stop") / BLOCK))))
    met = points.withColumn("block", F.floor(F.col("line") / BLOCK)).join(cut, [key, "block"]).where("line between start and stop")
    return met.groupBy(key, "line").agg(F.max_by("name", F.struct("depth", (-F.col("start")).alias("s"), F.col("name"))).alias("name"))


def touched(changes: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Spans that overlap a changed range (key, low, high), less those that contain another such span; all where that
    leaves none. One sort by key: a span contains another if one that starts no earlier ends before it, or with it."""
    met = changes.join(spans, key).where("stop >= low and start <= high").select(spans.columns).distinct()
    # Backwards, as a frame that grows is summed up as it goes; one that shrinks is summed up anew for each row.
    later = Window.partitionBy(key).orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    alike = Window.partitionBy(key, "stop").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    holds = (F.min("stop").over(later) < F.col("stop")) | (F.count("*").over(alike) > 1)
    met = met.withColumn("_holds", holds).withColumn("_all", F.min(F.col("_holds")).over(Window.partitionBy(key)))
    return met.where("not _holds or _all").select(spans.columns)


def union(ranges: DataFrame, key: str) -> DataFrame:
    """Ranges (key, low, high) of one key that overlap or adjoin, merged."""
    w = Window.partitionBy(key).orderBy("low", "high")
    runs = ranges.withColumn("before", F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("run", F.sum((F.col("before").isNull() | (F.col("low") > F.col("before") + 1)).cast("int")).over(w))
    return runs.groupBy(key, "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def budget(rows: DataFrame, cost: str, order: list, limit: int, by: str | None = None) -> DataFrame:
    """Rows in order until their costs exceed limit. Without `by` all rows meet in one task: cut to the top rows first."""
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= limit)


def best(rows: DataFrame, by: list[str], order: list, k: int = 1) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def elided(lines: DataFrame, bodies: DataFrame, key: str, number: str = "line", text: str = "text") -> DataFrame:
    """Lines (key, number, text) without those in bodies (key, low, high), one mark in the place of each run of them."""
    cut = union(bodies, key)
    inside = cut.select(key, F.explode(F.sequence("low", "high")).alias(number))
    marks = cut.select(key, F.col("low").alias(number), F.concat(F.lit("… "), (F.col("high") - F.col("low") + 1).cast("string"), F.lit(" lines")).alias(text))
    return lines.select(key, number, text).join(inside, [key, number], "left_anti").unionByName(marks)
