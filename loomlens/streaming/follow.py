"""Tables that follow a change feed, one running query for all who ask, and its progress as a table."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from loomlens.sources import feed
from loomlens.sources.versions import Versions


def follow_counts(spark: SparkSession, folder: str, target: str, state: str, limit: int = feed.LIMIT, overflow: int = feed.OVERFLOW, **trigger) -> StreamingQuery:
    """Keeps (key, n, last) under target: how often each key has changed, and where in the feed last.

    A batch of keys writes its own counts, as a table named by the batch; one that overflowed takes the full way and
    counts all of the feed up to it. Each batch is then committed, so a batch that is run again after a failure replaces
    what it half wrote, and one that was committed changes nothing.
    """
    versions = Versions(spark, target)

    def fold(batch: DataFrame, n: int) -> None:
        m = versions.last() or {"version": 0, "batch": -1, "tables": [], "full": 0}
        if n <= m["batch"]:
            return
        batch = batch.persist()
        over = batch.where("overflow").agg(F.max("seq")).first()[0]
        if over is not None:
            # The feed in order of its files: as many rows as the mark stands for.
            whole = spark.read.schema("key string").option("recursiveFileLookup", True).parquet(folder)
            counts = whole.select("key", F.lit(over).cast("long").alias("seq"))
            m |= {"tables": [], "full": m["full"] + 1}
        else:
            counts = batch.select("key", F.col("seq") + 1)
        counts.toDF("key", "seq").groupBy("key").agg(F.count("*").alias("n"), F.max("seq").alias("last")).write.mode("overwrite").parquet(f"{target}/{n:08d}")
        m |= {"version": m["version"] + 1, "batch": n, "tables": [*m["tables"], f"{n:08d}"]}
        versions.commit(m)
        batch.unpersist()

    return feed.follow(spark, folder, state, limit, overflow).writeStream.foreachBatch(fold).option("checkpointLocation", f"{state}/checkpoint").trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def counts(spark: SparkSession, target: str) -> DataFrame:
    m = Versions(spark, target).last()
    if not m or not m["tables"]:
        return spark.createDataFrame([], "key string, n long, last long")
    rows = spark.read.parquet(*[f"{target}/{t}" for t in m["tables"]])
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


_starting = threading.Lock()


def shared(spark: SparkSession, name: str, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """The running query of that name; started by the first who asks, whoever asks meanwhile gets the same."""
    with _starting:
        for q in spark.streams.active:
            if q.name == name:
                return q
        return start()


class Progress(StreamingQueryListener):
    """Notes each batch's progress as a small file of its own under folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.folder = folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {"name": p.name, "id": str(p.id), "run": str(p.runId), "batch": p.batchId, "rows": p.numInputRows, "ms": p.durationMs.get("triggerExecution", 0)}
        at = f"{row['run']}-{p.batchId:08d}"
        stream = self._fs.create(self._path(f"{self.folder}/_{at}"))
        stream.write(bytearray(json.dumps(row).encode()))
        stream.close()
        if p.numInputRows:
            self._fs.rename(self._path(f"{self.folder}/_{at}"), self._path(f"{self.folder}/{at}.json"))

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """(name, id, run, batch, rows, ms) of batches that read anything."""
    return spark.read.schema("name string, id string, run string, batch long, rows long, ms long").json(folder)
