"""A change feed as a streaming source: keys that changed, in the order in which they were published.

A feed is a folder of Parquet files, in the order of their paths; a row's place among all rows is its offset. A batch has
at most `limit` rows. A reader that has fallen behind by more than `overflow` rows doesn't follow: its batch is one mark
(overflow is true, key null) for all of them, which tells whoever reads it to look at everything anew. What has been
committed is noted in the folder of the consumer's `state`, so that a restarted reader goes on from there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "seq long, key string, overflow boolean"
LIMIT, OVERFLOW = 400, 400


def publish(changes: DataFrame, folder: str, part: int, order: list[str]) -> None:
    """Appends changes (key and what they are ordered by) to a feed; a part that is written again replaces itself."""
    n = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    changes.repartitionByRange(n, *order).sortWithinPartitions(*order).selectExpr("cast(key as string) as key").write.mode("overwrite").parquet(f"{folder}/{part:06d}")


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    fs, at = pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)
    return fs, at.rstrip("/")


class Piece(InputPartition):
    def __init__(self, file: str | None, first: int, rows: int, seq: int) -> None:
        self.file, self.first, self.rows, self.seq = file, first, rows, seq


class FeedReader(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.folder, self.state = options["path"], options.get("state")
        self.limit, self.overflow = int(options.get("limit", LIMIT)), int(options.get("overflow", OVERFLOW))
        self.known: dict[str, int] = {}
        self.proposed = self._committed()

    def _committed(self) -> int:
        if self.state:
            fs, at = _opened(self.state)
            if fs.get_file_info(f"{at}/committed.json").type == pafs.FileType.File:
                with fs.open_input_stream(f"{at}/committed.json") as f:
                    return json.loads(f.read())["rows"]
        return 0

    def _files(self) -> list[tuple[str, int]]:
        """Files of finished parts with their rows, in order; a footer is read once."""
        fs, at = _opened(self.folder)
        if fs.get_file_info(at).type != pafs.FileType.Directory:
            return []
        found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
        done = {x.path.rpartition("/")[0] for x in found if x.base_name == "_SUCCESS"}
        for path in sorted(x.path for x in found if x.base_name.endswith(".parquet") and x.path.rpartition("/")[0] in done):
            if path not in self.known:
                with fs.open_input_file(path) as f:
                    self.known[path] = pq.read_metadata(f).num_rows
        return sorted(self.known.items())

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        total = sum(n for _, n in self._files())
        behind = total - self.proposed
        self.proposed += behind if behind > self.overflow else min(behind, self.limit)
        return {"rows": self.proposed}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        first, last = start["rows"], end["rows"]
        self.proposed = max(self.proposed, last)
        if last - first > self.overflow:
            return [Piece(None, 0, 1, last)]
        pieces, before = [], 0
        for path, n in self._files():
            low, high = max(first, before), min(last, before + n)
            if low < high:
                pieces.append(Piece(path, low - before, high - low, low))
            before += n
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("seq", pa.int64()), ("key", pa.string()), ("overflow", pa.bool_())])
        if partition.file is None:
            yield pa.RecordBatch.from_pylist([{"seq": partition.seq, "key": None, "overflow": True}], schema=schema)
            return
        fs, _ = _opened(self.folder)
        at, left, seq = 0, partition.first, partition.seq
        with fs.open_input_file(partition.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=["key"]):
                low = max(0, left - at)
                rows = batch.slice(low, max(0, partition.first + partition.rows - at - low))
                at += len(batch)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(range(seq, seq + len(rows)), pa.int64()), rows.column(0), pa.array([False] * len(rows))], schema=schema)
                    seq += len(rows)
                if at >= partition.first + partition.rows:
                    return

    def commit(self, end: dict) -> None:
        if self.state:
            fs, at = _opened(self.state)
            fs.create_dir(at, recursive=True)
            with fs.open_output_stream(f"{at}/_committed.json") as f:
                f.write(json.dumps(end).encode())
            fs.move(f"{at}/_committed.json", f"{at}/committed.json")


class Feed(DataSource):
    """format("change_feed"), options path, state, limit, overflow."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(self.options)


def follow(spark: SparkSession, folder: str, state: str, limit: int = LIMIT, overflow: int = OVERFLOW) -> DataFrame:
    """A feed as a stream (seq, key, overflow)."""
    spark.dataSource.register(Feed)
    return spark.readStream.format("change_feed").option("path", folder).option("state", state).option("limit", limit).option("overflow", overflow).load()
