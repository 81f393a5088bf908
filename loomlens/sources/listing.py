"""A source tree as a table, listed in rounds: each round opens the folders that the one before it found.

Folders are rows, so that executors list them and the driver holds none. A row carries the folders above it whose ignore
files apply; an executor reads those files as it needs them. The tree is one that all executors see under the same path.
"""

from __future__ import annotations

import functools
import os
import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlens.sources.shared import written
from loomlens.sources.workspace import BYTES_MAX, DEPTH_MAX, SNIFF, Ignore

#: Rows that leave a task at once, so that a folder of any size is listed in bounded memory.
ROWS = 5000
#: Most bytes of contents that leave a task at once; one file beyond that leaves alone.
BATCH_BYTES = 8 << 20
FOUND = "path string, folder boolean, rules array<string>, size long, mtime_ms long"


def _rules(root: str, folder: str) -> str | None:
    try:
        with open(os.path.join(root, folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


def _opened(frames: Iterator[pd.DataFrame], root: str, starts: str, ends: str) -> Iterator[pd.DataFrame]:
    """What stands in each folder: files that count, and folders that may hold some."""

    @functools.lru_cache(64)
    def ignore(above: tuple[str, ...]) -> Ignore:
        rules = Ignore()
        for folder in above:
            rules.add(_rules(root, folder) or "", folder)
        return rules

    for frame in frames:
        rows: list[tuple] = []
        for at, above in zip(frame["path"], frame["rules"], strict=True):
            above = tuple(above)
            if _rules(root, at) is not None:
                above = (*above, at)
            try:
                inside = os.scandir(os.path.join(root, at))
            except FileNotFoundError:  # gone since it was listed, as its files are
                continue
            with inside:
                for e in inside:
                    path = posixpath.join(at, e.name)
                    if e.is_symlink() or e.name == ".git":
                        continue
                    if e.is_dir():
                        if (path + "/").startswith(starts) or starts.startswith(path + "/"):
                            rows.append((path, True, list(above), None, None))
                    elif path.startswith(starts) and path.endswith(ends):
                        rows.append((path, False, list(above), e.stat().st_size, e.stat().st_mtime_ns // 1_000_000))
                    else:
                        continue
                    if rows and rows[-1][0] == path and ignore(above).ignores(path, rows[-1][1]):
                        rows.pop()
                    if len(rows) >= ROWS:
                        yield _frame(rows)
                        rows = []
        yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["path", "folder", "rules", "size", "mtime_ms"])
    return frame.astype({"size": "Int64", "mtime_ms": "Int64"})


def listed(spark: SparkSession, root: str, starts: str = "", ends: str = "", depth: int = DEPTH_MAX) -> DataFrame:
    """(path, size, mtime_ms) of a tree's files whose path has the given beginning and end, in no order.

    As workspace.walk has it: symbolic links and ignored files are left out, ignored folders and those more than `depth`
    below the root are not opened; nor are folders that can't hold a path of that beginning. No number of files is too
    many. An empty tree gives an empty table; a root that is no folder is an error.
    """
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    found = spark.createDataFrame([("", True, [], None, None)], FOUND)
    files = found.where("not folder")
    slots = 2 * spark.sparkContext.defaultParallelism
    for _ in range(depth + 1):
        folders = found.where("folder").select("path", "rules")
        if folders.head() is None:
            break
        opened = folders.repartition(slots, "path").mapInPandas(functools.partial(_opened, root=root, starts=starts, ends=ends), FOUND)
        found = written(opened, "listed")
        files = files.unionByName(found.where("not folder"))
    return files.select("path", "size", "mtime_ms")


def _read(frames: Iterator[pd.DataFrame], root: str, most: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows, held = [], 0
        for path, size, mtime in frame.itertuples(index=False):
            content = None
            if size <= most:
                with open(os.path.join(root, path), "rb") as f:
                    data = f.read()
                content = None if b"\0" in data[:SNIFF] else data.decode("utf-8", "replace")
                held += len(data)
            rows.append((path, size, mtime, content))
            if held >= BATCH_BYTES:
                yield pd.DataFrame(rows, columns=["path", "size", "mtime_ms", "content"])
                rows, held = [], 0
        yield pd.DataFrame(rows, columns=["path", "size", "mtime_ms", "content"])


def tree(spark: SparkSession, root: str, starts: str = "", ends: str = "", most: int = BYTES_MAX) -> DataFrame:
    """listed with content, in the schema of the workspace source; content is null for binary files and those of more
    than `most` bytes."""
    files = listed(spark, root, starts, ends)
    spread = files.repartition(2 * spark.sparkContext.defaultParallelism, F.col("path"))
    return spread.mapInPandas(functools.partial(_read, root=root, most=most), "path string, size long, mtime_ms long, content string")
