"""The change feed, tables that follow it, handle stores and progress: restarts, overflow, eviction, empty input."""

import collections
import random

from pyspark.sql import functions as F

from loomlens.sources import feed
from loomlens.sources.shared import fresh
from loomlens.streaming import follow, handles


def published(spark, at, part, keys, first=0):
    rows = spark.createDataFrame([(first + i, k) for i, k in enumerate(keys)], "i long, key string")
    feed.publish(rows, f"{at}/feed", part, ["i"])


def follow_all(spark, at, **how):
    q = follow.follow_counts(spark, f"{at}/feed", f"{at}/counts", f"{at}/state", **how)
    q.processAllAvailable()
    batches = [p["batchId"] for p in q.recentProgress if p["numInputRows"]]
    q.stop()
    return batches


def counted(spark, at):
    return {r.key: (r.n, r["last"]) for r in follow.counts(spark, f"{at}/counts").collect()}


def plain(keys):
    return {k: (n, max(i for i, x in enumerate(keys, 1) if x == k)) for k, n in collections.Counter(keys).items()}


def test_each_row_is_seen_once_over_restarts(spark):
    rng, at, keys = random.Random(1), fresh(spark, "feed"), []
    assert follow_all(spark, at) == [] and counted(spark, at) == {}
    for part in range(3):
        more = [f"k{rng.randrange(9)}" for _ in range(55)]
        published(spark, at, part, more)
        keys += more
        assert len(follow_all(spark, at, limit=30, overflow=100)) == 2
        assert counted(spark, at) == plain(keys)
    assert follow_all(spark, at, limit=30, overflow=100) == []


def test_too_many_changes_take_the_full_way(spark):
    at = fresh(spark, "feed")
    first, more = ["a"] * 20 + ["b"] * 5, ["c"] * 300
    published(spark, at, 0, first)
    follow_all(spark, at, limit=10, overflow=100)
    published(spark, at, 1, more)
    assert len(follow_all(spark, at, limit=10, overflow=100)) == 1
    assert {k: n for k, (n, _) in counted(spark, at).items()} == {"a": 20, "b": 5, "c": 300}
    m = follow.Versions(spark, f"{at}/counts").last()
    assert m["full"] == 1 and len(m["tables"]) == 1


def test_limits_and_pieces():
    """Pieces of any range hold the rows of the range, whatever the files are."""
    reader = feed.FeedReader({"path": "/nowhere", "limit": "7", "overflow": "50"})
    assert reader.latestOffset() == {"rows": 0} and reader.partitions({"rows": 0}, {"rows": 0}) == []
    reader._files = lambda: [("a", 5), ("b", 0), ("c", 20)]
    assert [reader.latestOffset()["rows"] for _ in range(5)] == [7, 14, 21, 25, 25]
    for low in range(26):
        for high in range(low, 26):
            pieces = reader.partitions({"rows": low}, {"rows": high})
            assert sum(p.rows for p in pieces) == high - low and all(p.rows > 0 for p in pieces)
    reader.overflow = 10
    assert [p.file for p in reader.partitions({"rows": 0}, {"rows": 11})] == [None]


def test_unfinished_parts_are_not_read(spark):
    at = fresh(spark, "feed")
    published(spark, at, 0, ["a"])
    spark.createDataFrame([("b",)], "key string").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{at}/feed/000001")
    reader = feed.FeedReader({"path": f"{at}/feed"})
    assert reader.latestOffset() == {"rows": 1}


def test_stores_keep_what_was_used_last(spark):
    rng, at = random.Random(3), fresh(spark, "handles")
    uses = [(f"u{rng.randrange(3)}", f"h{rng.randrange(12)}", i) for i in range(150)]
    for k in range(3):
        spark.createDataFrame(uses[k * 50 : k * 50 + 50], "user string, handle string, used long").write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema("user string, handle string, used long").parquet(f"{at}/in")
        handles.keep_handles(stream, f"{at}/state", f"{at}/evicted", 4).awaitTermination()
        last = {}
        for u, h, i in uses[: k * 50 + 50]:
            last.setdefault(u, {})[h] = i
        want = {(u, h, i) for u, hs in last.items() for h, i in sorted(hs.items(), key=lambda x: -x[1])[:4]}
        assert {tuple(r) for r in handles.handles(spark, f"{at}/state").collect()} == want
    gone = spark.read.parquet(f"{at}/evicted").collect()
    assert gone and all((r.user, r.handle, r.used) not in want for r in gone)


def test_one_query_for_all_and_its_progress(spark):
    at = fresh(spark, "progress")
    spark.range(90).repartition(3).write.parquet(f"{at}/in")
    listener, started = follow.Progress(spark, f"{at}/progress"), []

    def start():
        started.append(1)
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        return stream.writeStream.queryName("one").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").start()

    spark.streams.addListener(listener)
    try:
        q = [follow.shared(spark, "one", start) for _ in range(3)]
        q[0].processAllAvailable()
        assert len(started) == 1 and len({x.runId for x in q}) == 1
        q[0].stop()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    rows = follow.progress(spark, f"{at}/progress").where(F.col("name") == "one")
    assert rows.agg(F.sum("rows")).first()[0] == 90 and rows.count() == 3
