"""Running sums, numbers, filled values and segments over a whole table in order, without one task that reads it all.

Rows are dealt into ranges of the order; each range is worked on alone, by a window. What a range hands on to those after
it is one row: its sum, its number of rows, its last value. Those rows, as many as there are ranges, are carried over in
the driver and added back to each range's own results. Equal keys may fall into several ranges, so no key is too large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlens.sources.shared import fresh

PART, TIE = "_part", "_tie"


def ranged(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """df with the range of each row (_part, ascending) and its place among equal keys (_tie), kept in the shared folder
    by range: bounds are drawn once, and what reads some ranges opens no others."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn(TIE, F.monotonically_increasing_id()).repartitionByRange(parts, *order, TIE).withColumn(PART, F.spark_partition_id())
    path = fresh(spark, "ranges")
    dealt.write.partitionBy(PART).parquet(path)
    # An empty table has no folder to take the range from.
    return spark.read.schema(dealt.schema).parquet(path)


def _own(order: list[str]):
    return Window.partitionBy(PART).orderBy(*order, TIE).rowsBetween(Window.unboundedPreceding, 0)


def _joined(rows: DataFrame, before: dict[int, object], kind: str) -> DataFrame:
    """rows with what comes before their range as `_before`; a row a range is broadcast."""
    table = rows.sparkSession.createDataFrame(sorted(before.items()), f"{PART} int, _before {kind}")
    return rows.join(F.broadcast(table), PART, "left")


def _sums(held: DataFrame, cost: Column) -> tuple[dict[int, int], dict[int, int]]:
    """For each range what the ranges before it sum to, and what it sums to."""
    own = {r[0]: r[1] or 0 for r in held.groupBy(PART).agg(F.sum(cost)).collect()}  # a row a range
    before, total = {}, 0
    for p in sorted(own):
        before[p] = total
        total += own[p]
    return before, own


def running(df: DataFrame, cost: Column, order: list[str], name: str = "used", parts: int | None = None) -> DataFrame:
    """df with the sum of cost (whole numbers, null as nothing) over all rows up to each one."""
    held = ranged(df, order, parts)
    before, _ = _sums(held, cost)
    summed = held.withColumn("_sum", F.sum(F.coalesce(cost, F.lit(0)).cast("long")).over(_own(order)))
    return _joined(summed, before, "long").withColumn(name, F.col("_sum") + F.col("_before")).drop(PART, TIE, "_sum", "_before")


def numbered(df: DataFrame, order: list[str], name: str = "n", parts: int | None = None) -> DataFrame:
    """df with 1, 2, 3... in order."""
    return running(df, F.lit(1), order, name, parts)


def segments(df: DataFrame, begins: Column, order: list[str], name: str = "segment", parts: int | None = None) -> DataFrame:
    """df with the number of rows so far that begin a segment."""
    return running(df, F.coalesce(begins, F.lit(False)).cast("long"), order, name, parts)


def budget(df: DataFrame, cost: Column, order: list[str], limit: int, name: str = "used", parts: int | None = None) -> DataFrame:
    """The first rows, in order, whose costs (none below 0) together stay within limit. Ranges that begin beyond it are
    neither opened nor summed up row by row."""
    held = ranged(df, order, parts)
    before, _ = _sums(held, cost)
    within = {p: n for p, n in before.items() if n <= limit}
    some = held.where(F.col(PART).isin(*within)) if within else held.limit(0)
    summed = some.withColumn("_sum", F.sum(F.coalesce(cost, F.lit(0)).cast("long")).over(_own(order)))
    return _joined(summed, within, "long").withColumn(name, F.col("_sum") + F.col("_before")).where(F.col(name) <= limit).drop(PART, TIE, "_sum", "_before")


def filled(df: DataFrame, value: Column, order: list[str], name: str = "filled", parts: int | None = None) -> DataFrame:
    """df with the last value that isn't null up to each row."""
    held = ranged(df, order, parts).withColumn("_value", value)
    there = held.where("_value is not null").groupBy(PART).agg(F.max_by("_value", F.struct(*order, TIE)).alias("v")).collect()  # a row a range
    last, before, ends = None, {}, {r[0]: r["v"] for r in there}
    for p in range(max(ends, default=-1) + 2 if ends else 0):
        before[p] = last
        last = ends.get(p, last)
    kind = held.schema["_value"].dataType.simpleString()
    top = max(before, default=-1)
    after = F.lit(last).cast(kind)  # ranges after the last one with a value
    rows = _joined(held.withColumn("_last", F.last("_value", ignorenulls=True).over(_own(order))), before, kind)
    carried = F.when(F.col(PART) > top, after).otherwise(F.col("_before"))
    return rows.withColumn(name, F.coalesce("_last", carried)).drop(PART, TIE, "_value", "_last", "_before")
