"""Handles by last use, as keyed state of a stream: a store for each user, so that no task holds all of them.

A use of a handle notes when it was; a store that holds more than its capacity lets go of what was used longest ago. The
stores lie in the stream's checkpoint and are read from there as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CAPACITY = 4096
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastUsed(StatefulProcessor):
    """Rows (user, handle, used) in; out (user, handle, used) of handles that a store let go of."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle.getMapState("handles", "handle string", "used long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        uses: dict[str, int] = {}
        for r in rows:
            uses[r.handle] = max(r.used, uses.get(r.handle, r.used))
        held = {k[0]: v[0] for k, v in self.store.iterator()}  # capacity at most
        for handle, used in uses.items():
            uses[handle] = max(used, held.get(handle, used))
        every = held | uses
        gone = sorted(every, key=lambda h: (every[h], h))[: max(0, len(every) - self.capacity)]
        for handle in gone:
            if handle in held:
                self.store.removeKey((handle,))
            yield Row(user=key[0], handle=handle, used=every.pop(handle))
        for handle in uses:
            if handle in every and held.get(handle) != every[handle]:
                self.store.updateValue((handle,), (every[handle],))

    def close(self) -> None: ...


def keep_handles(uses: DataFrame, checkpoint: str, evicted: str, capacity: int = CAPACITY, **trigger) -> StreamingQuery:
    """Keeps the stores of a stream of uses (user, handle, used), and writes what they let go of to the folder evicted."""
    spark = uses.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # a query keeps the settings that it starts with
    try:
        out = uses.groupBy("user").transformWithState(LastUsed(capacity), "user string, handle string, used long", "append", "None")
        return out.writeStream.format("parquet").option("path", evicted).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(PROVIDER, before)


def handles(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(user, handle, used) of all stores, as the last batch left them."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        rows = spark.read.format("statestore").option("stateVarName", "handles").load(checkpoint)
    finally:
        spark.conf.set(PROVIDER, before)
    return rows.select(F.col("key.user").alias("user"), F.col("user_map_key.handle").alias("handle"), F.col("user_map_value.used").alias("used"))
