"""A source tree as a table: ignore rules, a listing data source, path containment."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringEndsWith, StringStartsWith

DEPTH_MAX, FILES_MAX, BYTES_MAX, SNIFF = 24, 20_000, 524_288, 8192
SCHEMA = "path string, size long, mtime_ms long, content string"


class PathEscape(ValueError):
    """A path that leads out of the workspace."""


def contained(root: str, relative: str) -> str:
    """The normal form of a path inside root."""
    full = os.path.realpath(os.path.join(root, relative))
    top = os.path.realpath(root)
    if full != top and not full.startswith(top + os.sep):
        raise PathEscape(relative)
    return os.path.relpath(full, top).replace(os.sep, "/")


@dataclass(frozen=True)
class Rule:
    base: str
    negated: bool
    directory_only: bool
    pattern: re.Pattern


def compile_rule(line: str, base: str = "") -> Rule | None:
    """One line of an ignore file; None for blanks and comments."""
    text = line.rstrip("\r\n")
    if not text.strip() or text.startswith("#"):
        return None
    text = text.strip() if not text.rstrip().endswith("\\") else text.lstrip()
    negated = text.startswith("!")
    text = text[negated:]
    text = text[1:] if text.startswith(("\\#", "\\!")) else text
    directory_only = text.endswith("/")
    text = text.rstrip("/")
    anchored = "/" in text
    out, i = "", 0
    text = text.lstrip("/")
    while i < len(text):
        if text.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif text.startswith("/**", i) and i + 3 == len(text):
            out, i = out + "/.*", i + 3
        elif text[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif text[i] == "?":
            out, i = out + "[^/]", i + 1
        elif text[i] == "[" and (end := text.find("]", i + 2)) > 0:
            out, i = out + "[" + ("^" if text[i + 1] in "!^" else "") + text[i + 1 + (text[i + 1] in "!^") : end].replace("\\", "\\\\") + "]", end + 1
        else:
            i += text[i] == "\\" and i + 1 < len(text)
            out, i = out + re.escape(text[i]), i + 1
    return Rule(base, negated, directory_only, re.compile(("" if anchored else "(?:.*/)?") + out))


class Ignore:
    """Rules in order; the last that fits decides."""

    def __init__(self) -> None:
        self.rules: list[Rule] = []

    def add(self, text: str, base: str = "") -> Ignore:
        self.rules += [r for line in text.splitlines() if (r := compile_rule(line, base))]
        return self

    def ignores(self, path: str, is_dir: bool) -> bool:
        out = False
        for r in self.rules:
            if r.base and not path.startswith(r.base + "/"):
                continue
            rest = path[len(r.base) + 1 :] if r.base else path
            parts = rest.split("/")
            # A rule that fits a directory above holds for all that is in it.
            above = any(r.pattern.fullmatch("/".join(parts[:k])) for k in range(1, len(parts)))
            if above or (is_dir or not r.directory_only) and r.pattern.fullmatch(rest):
                out = not r.negated
        return out


def walk(root: str, starts: str = "", ends: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, size, mtime in ms) in path order, of paths with that beginning and end; symbolic links are left out, ignored
    directories and those that can't hold such paths are not entered."""
    ignore = Ignore()

    def visit(at: str, depth: int) -> Iterator[tuple[str, int, int]]:
        full = os.path.join(root, at)
        own = os.path.join(full, ".gitignore")
        if os.path.isfile(own):
            with open(own, encoding="utf-8", errors="replace") as f:
                ignore.add(f.read(), at)
        for e in os.scandir(full):
            path = posixpath.join(at, e.name)
            if e.is_symlink() or e.name == ".git":
                continue
            if e.is_dir():
                leads = (path + "/").startswith(starts) or starts.startswith(path + "/")
                if leads and depth < DEPTH_MAX and not ignore.ignores(path, True):
                    yield from visit(path, depth + 1)
            elif path.startswith(starts) and path.endswith(ends) and not ignore.ignores(path, False):
                s = e.stat()
                yield path, s.st_size, s.st_mtime_ns // 1_000_000

    return iter(sorted(visit("", 0)))


@dataclass
class _Slice(InputPartition):
    files: list[tuple[str, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.most = options["path"], int(options.get("maxfiles", FILES_MAX))
        self.starts = self.ends = ""
        self.bytes, self.slices = int(options.get("maxbytes", BYTES_MAX)), int(options.get("slices", 8))

    def partitions(self) -> list[InputPartition]:
        files = list(walk(self.root, self.starts, self.ends))[: self.most]
        n = max(1, -(-len(files) // self.slices))
        return [_Slice(files[i : i + n]) for i in range(0, len(files), n)] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for path, size, mtime in partition.files:
            content = None
            if size <= self.bytes:
                with open(os.path.join(self.root, path), "rb") as f:
                    data = f.read()
                content = None if b"\0" in data[:SNIFF] else data.decode("utf-8", "replace")
            yield path, size, mtime, content


class _Pushed(_Reader):
    """Conditions on path that the walk itself keeps: a beginning, an end, one path; one of each, others stay Spark's.
    `maxfiles` then counts the files that meet them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            on_path = getattr(f, "attribute", None) == ("path",)
            if on_path and isinstance(f, StringStartsWith) and not self.starts:
                self.starts = f.value
            elif on_path and isinstance(f, StringEndsWith) and not self.ends:
                self.ends = f.value
            else:
                if on_path and isinstance(f, EqualTo) and not self.starts:
                    self.starts = f.value  # narrows the walk; Spark compares whole paths
                yield f


class Workspace(DataSource):
    """spark.dataSource.register(Workspace); spark.read.format("workspace").load(root). content is null for binary and
    over-large files. The tree is one that the driver and all executors see under the same path; listing.tree lists one of any size on the executors.

    With the option `push`, conditions on path reach the walk; the session then needs
    spark.sql.python.filterPushdown.enabled."""

    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (_Pushed if options.get("push") == "true" else _Reader)(options)
