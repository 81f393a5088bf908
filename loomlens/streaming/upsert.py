"""Latest row per key, kept up by a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: one pass with partial aggregation, no window."""
    rest = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def stream_latest(spark: SparkSession, source: str, schema, key: str, order: list[str], target: str, checkpoint: str) -> DataFrame:
    """Folds new files of source into the table under target, batch by batch, and returns it.

    Each batch writes a version of its own, named by the batch, from the version before it: a batch that is run again
    after a failure overwrites what it half wrote, and readers of the last version are not disturbed.
    """

    def fold(batch: DataFrame, n: int) -> None:
        known = batch
        if n:
            known = batch.unionByName(spark.read.schema(schema).parquet(f"{target}/{n - 1:06d}"))
        latest(known, key, order).select(*schema.names).write.mode("overwrite").parquet(f"{target}/{n:06d}")

    query = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    n = query.lastProgress["batchId"] if query.lastProgress else 0
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else [f"{n:06d}"]
    return spark.read.schema(schema).parquet(f"{target}/{last[-1]}")
