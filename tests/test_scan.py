"""Distributed scans against plain loops, with ties, nulls, empty ranges and empty tables, and no task that reads all."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from loomlens.operators import scan

KIND = "k int, i int, cost int, value string, begins boolean"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    # A third of the rows share one key.
    out = [(7 if rng.random() < 0.34 else rng.randrange(50), i, rng.choice([0, 1, 5, None]), rng.choice([None, None, None, "a", "b"]), rng.choice([True, False, False, None])) for i in range(700)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows[::-1], KIND).repartition(5)


@pytest.mark.parametrize("parts", [1, 23])
def test_scans_are_those_of_a_loop(spark, rows, parts):
    df, order = table(spark, rows), ["k", "i"]
    used = list(itertools.accumulate(r[2] or 0 for r in rows))
    got = {r.i: r.used for r in scan.running(df, F.col("cost"), order, parts=parts).collect()}
    assert got == {r[1]: u for r, u in zip(rows, used, strict=True)}
    got = {r.i: r.segment for r in scan.segments(df, F.col("begins"), order, parts=parts).collect()}
    assert got == {r[1]: n for r, n in zip(rows, itertools.accumulate(int(bool(r[4])) for r in rows), strict=True)}
    last, want = None, {}
    for r in rows:
        last = r[3] or last
        want[r[1]] = last
    assert {r.i: r.filled for r in scan.filled(df, F.col("value"), order, parts=parts).collect()} == want
    for limit in (0, 200, used[-1]):
        got = sorted((r.k, r.i) for r in scan.budget(df, F.col("cost"), order, limit, parts=parts).collect())
        assert got == [r[:2] for r, u in zip(rows, used, strict=True) if u <= limit]


def test_equal_rows_are_numbered_one_by_one(spark):
    df = spark.createDataFrame([(1,)] * 500 + [(0,)] * 3 + [(None,)] * 2, "k int")
    got = sorted((r.n, r.k) for r in scan.numbered(df, ["k"], parts=7).collect())
    assert got == list(enumerate([None] * 2 + [0] * 3 + [1] * 500, 1))


def test_empty_and_null(spark):
    none = spark.createDataFrame([], KIND)
    assert scan.running(none, F.col("cost"), ["k"]).columns == [*none.columns, "used"]
    for got in (scan.running(none, F.col("cost"), ["k"]), scan.filled(none, F.col("value"), ["k"]), scan.budget(none, F.col("cost"), ["k"], 9), scan.segments(none, F.col("begins"), ["k"])):
        assert got.collect() == []
    blank = spark.createDataFrame([(1, 1, None, None, None)] * 4, KIND)
    assert [r.filled for r in scan.filled(blank, F.col("value"), ["k"]).collect()] == [None] * 4


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_no_exchange_to_one_task_and_early_stop(spark, rows):
    df = table(spark, rows)
    for got in (scan.running(df, F.col("cost"), ["k", "i"], parts=9), scan.filled(df, F.col("value"), ["k", "i"], parts=9)):
        assert "SinglePartition" not in plan(got)
    assert re.search(r"PartitionFilters: \[[^\]]*_part", plan(scan.budget(df, F.col("cost"), ["k", "i"], 20, parts=20)))
