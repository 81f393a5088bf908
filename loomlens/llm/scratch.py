"""Tables written to the folder that the cluster shares, to cut lineage and to be read more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="loomlens-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/loomlens/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: Shuffle files go as soon as an action ends, not when the driver next collects its garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of DataFrames that are made within it go when their action ends; for large shuffles that nothing reads
    again."""
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE, before or "false")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, kept as Parquet in the shared folder and read from there."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows, and most bytes, of texts that go to a Python worker at once; one text longer than that goes alone.
BATCH, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds of long texts; a session's own smaller bounds stay. Set for the session, as
    results are lazy."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)
