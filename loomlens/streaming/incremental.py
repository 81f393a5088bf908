"""Keeping parsed files and import edges up to date from a feed of changed paths.

A state is three tables: files, parsed, references. A batch of paths touches what it names; a lost track (null), a file
that shapes the scan, or a path that stands for a folder brings a full walk. The result is what a rebuild would give.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlens.operators import parse
from loomlens.plans import tools
from loomlens.sources.shared import written

# Folders whose changes matter to nothing, files that decide what is scanned, most paths of a batch.
NOISE = (".git", "node_modules", "dist", "build", "out", "target", "coverage", ".next", "__pycache__", ".venv")
SHAPING = (".gitignore", *tools.MANIFESTS)
PATHS_MAX = 400
STAMP = ["path", "size", "mtime_ms"]


class State(NamedTuple):
    files: DataFrame  # path, size, mtime_ms
    parsed: DataFrame
    resolved: DataFrame  # src, ref, dst


def wanted(paths: list[str] | None) -> list[str] | None:
    """Paths of a batch that matter; null where they are too many to follow, or shape the scan."""
    if paths is None:
        return None
    kept = sorted({p for p in paths if not set(p.split("/")) & set(NOISE)})
    return None if len(kept) > PATHS_MAX or any(p.rpartition("/")[2] in SHAPING for p in kept) else kept


def stamped(state: State, listing: DataFrame, paths: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """(stale, gone) paths: listed files that are new or have another size or time, and known ones that are no more.

    listing is the tree as it is now; named paths alone are compared with it, unless one stands for a folder.
    """
    now, known = listing.select(*STAMP), state.files
    if paths is not None:
        folders = [F.col("path").startswith(p + "/") for p in paths]
        inside = folders[0] if folders else F.lit(False)
        for f in folders[1:]:
            inside = inside | f
        if not known.unionByName(now).where(inside).head():
            now, known = now.where(F.col("path").isin(*paths)), known.where(F.col("path").isin(*paths))
    return now.join(known, STAMP, "left_anti").select("path"), known.join(now, "path", "left_anti").select("path")


def build(listing: DataFrame) -> State:
    """The state of a tree (path, size, mtime_ms, content) from nothing."""
    parsed = written(parse.parse_files(listing.where("content is not null")), "parsed")
    return State(written(listing.select(*STAMP), "files"), parsed, written(tools.resolve(parsed, listing.select("path")), "resolved"))


def apply(state: State, listing: DataFrame, paths: list[str] | None) -> State:
    """The state after a batch. Only stale files are parsed; where files came or went all references are resolved anew,
    else those of edited files."""
    paths = wanted(paths)
    if paths == []:
        return state
    stale, gone = stamped(state, listing, paths)
    stale, gone = written(stale, "stale"), written(gone, "gone")
    touched = stale.unionByName(gone)
    new = listing.join(F.broadcast(stale) if paths is not None else stale, "path", "left_semi")
    files = written(state.files.join(touched, "path", "left_anti").unionByName(new.select(*STAMP)), "files")
    fresh = written(parse.parse_files(new.where("content is not null")), "fresh")
    parsed = written(state.parsed.join(touched, "path", "left_anti").unionByName(fresh), "parsed")
    members = gone.head() or stale.join(state.files, "path", "left_anti").head()
    if members:
        return State(files, parsed, written(tools.resolve(parsed, files.select("path")), "resolved"))
    kept = state.resolved.join(stale.withColumnRenamed("path", "src"), "src", "left_anti")
    return State(files, parsed, written(kept.unionByName(tools.resolve(fresh, files.select("path"))), "resolved"))
