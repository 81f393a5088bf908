"""Notes as a writable source: one JSON file, replaced by a rename, that holds the newest notes only.

A task hands on the newest of its notes, as many as the file holds, and writes nothing itself; the commit puts them and
the ones that were there together and renames the new file into place. So an abort has nothing to take back. A file that
can't be read counts as empty, so that a damaged one doesn't stop what comes after it.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, WriterCommitMessage

SCHEMA = "id string, text string, paths array<string>, tags array<string>, created_at string"
FIELDS = ("id", "text", "paths", "tags", "created_at")
#: Fixed value: as many notes as a file holds.
MOST = 500


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    fs, at = pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)
    return fs, at.rstrip("/")


def _loaded(fs: pafs.FileSystem, at: str) -> list[dict]:
    try:
        with fs.open_input_stream(at) as f:
            rows = json.loads(f.read())
        return [{k: r.get(k) for k in FIELDS} for r in rows]
    except (OSError, ValueError, AttributeError, TypeError):
        return []


def _newest(notes: dict[str, dict], most: int) -> dict[str, dict]:
    return {r["id"]: r for r in heapq.nlargest(most, notes.values(), key=lambda r: (r["created_at"] or "", r["id"] or ""))}


@dataclass
class Handed(WriterCommitMessage):
    notes: list[dict]


class NotesWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.most, self.overwrite = options["path"], int(options.get("most", MOST)), overwrite

    def write(self, iterator: Iterator[Row]) -> Handed:
        kept: dict[str, dict] = {}
        for r in iterator:
            kept[r["id"]] = {k: r[k] for k in FIELDS}
            if len(kept) >= 2 * self.most:
                kept = _newest(kept, self.most)
        return Handed(list(_newest(kept, self.most).values()))

    def commit(self, messages: list) -> None:
        fs, at = _opened(self.path)
        notes = {} if self.overwrite else {r["id"]: r for r in _loaded(fs, f"{at}/notes.json")}
        for m in messages:
            notes |= {r["id"]: r for r in m.notes} if m else {}
        fs.create_dir(at, recursive=True)
        new = f"{at}/_{uuid.uuid4().hex}"
        with fs.open_output_stream(new) as f:
            f.write(json.dumps(list(_newest(notes, self.most).values())).encode())
        fs.move(new, f"{at}/notes.json")

    def abort(self, messages: list) -> None: ...


class NotesReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]

    def read(self, partition) -> Iterator[tuple]:
        fs, at = _opened(self.path)
        for r in _loaded(fs, f"{at}/notes.json"):
            yield tuple(r[k] for k in FIELDS)


class Notes(DataSource):
    """spark.dataSource.register(Notes); df.write.format("notes").mode("append").save(folder). The folder is one that the
    driver and all executors see under the same path; one writer at a time."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NotesReader:
        return NotesReader(self.options)

    def writer(self, schema, overwrite: bool) -> NotesWriter:
        return NotesWriter(self.options, overwrite)
