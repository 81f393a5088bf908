"""Ignore rules over tables of paths: all rules at once, as a trie over path segments.

A rule's segments are edges: a word, a pattern, or a globstar, which stays for any number of segments. A path is walked
from its beginning with the set of nodes that it may be at; what a node ends is noted, and the last rule noted decides.
So a path meets the edges of a few nodes, not every rule at each of its ancestors.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlens.sources.workspace import compile_rule

#: Rules up to which all go to every task; more are dealt out by the folder that they are of.
MOST = 20_000
#: Folders of which a task remembers where they lead, so that what lies in one folder is walked to once.
REMEMBERED = 10_000


class Node:
    __slots__ = ("words", "patterns", "star", "stays", "ends")

    def __init__(self, stays: bool = False) -> None:
        self.words: dict[str, Node] = {}
        self.patterns: dict[str, tuple[re.Pattern, Node]] = {}
        self.star: Node | None = None
        self.stays = stays
        self.ends: list[tuple[int, bool]] = []  # rule number, directories only


def _wild(segment: str) -> bool:
    return bool(re.search(r"[*?\[\\]", segment))


class Trie:
    """Rules (number, base, line); blank lines and comments are none."""

    def __init__(self, rules: list[tuple[int, str, str]]) -> None:
        self.root, self.negated = Node(), {}
        for number, base, line in rules:
            rule = compile_rule(line, base)
            if rule is None:
                continue
            self.negated[number] = rule.negated
            at = self.root
            for word in base.split("/") if base else []:
                at = at.words.setdefault(word, Node())
            text = line.strip() if not line.rstrip().endswith("\\") else line.lstrip()
            text = text[text.startswith("!") :]
            text = (text[1:] if text.startswith(("\\#", "\\!")) else text).rstrip("/")
            segments = text.lstrip("/").split("/")
            segments = segments if "/" in text else ["**", *segments]
            for i, s in enumerate(segments):
                if s == "**" and i < len(segments) - 1:
                    at.star = at.star or Node(stays=True)
                    at = at.star
                elif _wild(s):
                    at.patterns.setdefault(s, (compile_rule("/" + s).pattern, Node()))
                    at = at.patterns[s][1]
                else:
                    at = at.words.setdefault(s, Node())
            at.ends.append((number, rule.directory_only))
        self.known: dict[str, tuple[tuple[Node, ...], int]] = {"": (self._with_stars({self.root}), -1)}

    def _with_stars(self, nodes: set[Node]) -> tuple[Node, ...]:
        """Nodes with those that a globstar reaches without a segment."""
        every, new = set(nodes), list(nodes)
        while new:
            star = new.pop().star
            if star is not None and star not in every:
                every.add(star)
                new.append(star)
        return tuple(every)

    def _step(self, nodes: tuple[Node, ...], word: str) -> tuple[Node, ...]:
        out = set()
        for n in nodes:
            if word in n.words:
                out.add(n.words[word])
            out.update(to for pattern, to in n.patterns.values() if pattern.fullmatch(word))
            if n.stays:
                out.add(n)
        return self._with_stars(out)

    def _folder(self, path: str) -> tuple[tuple[Node, ...], int]:
        """Nodes at a folder, and the last rule that fits it or a folder above."""
        if path not in self.known:
            above, _, name = path.rpartition("/")
            nodes, last = self._folder(above)
            nodes = self._step(nodes, name)
            if len(self.known) > REMEMBERED:
                self.known = {"": self.known[""]}
            self.known[path] = nodes, max([last, *(r for n in nodes for r, _ in n.ends)])
        return self.known[path]

    def last(self, path: str, is_dir: bool) -> int:
        """The number of the last rule that fits; -1 for none."""
        above, _, name = path.rpartition("/")
        nodes, last = self._folder(above)
        return max([last, *(r for n in self._step(nodes, name) for r, folders in n.ends if is_dir or not folders)])


def _last(batches: Iterator[pa.RecordBatch], trie_of) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(b.column("path").to_pylist(), b.column("is_dir").to_pylist(), b.column("of").to_pylist(), strict=True)
        found = [trie_of(of).last(path, bool(is_dir)) if path else -1 for path, is_dir, of in rows]
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("is_dir"), pa.array(found, pa.int64())], ["path", "is_dir", "rule"])


def ignored(paths: DataFrame, rules: DataFrame, most: int = MOST) -> DataFrame:
    """(path, is_dir, rule, ignored) of distinct paths (path, is_dir) under rules (number, base, line): the last rule that
    fits the path, or a folder above it, decides; without one, a path is not ignored. base is the folder that a rule's
    file lies in, empty at the top. Null paths fit nothing.

    Few rules go to every task as one trie. Of more, each folder's are one row that meets the paths below that folder.
    """
    spark = paths.sparkSession
    paths = paths.select("path", "is_dir").distinct()
    negated = F.ltrim("line").startswith("!")
    few = rules.select("number", "base", "line").limit(most + 1).collect()
    if len(few) <= most:
        sent = spark.sparkContext.broadcast([(r.number, r.base or "", r.line) for r in few])

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = Trie(sent.value)
            return _last(batches, lambda _: trie)

        found = paths.select("path", "is_dir", F.lit("").alias("of")).mapInArrow(walk, "path string, is_dir boolean, rule long")
    else:
        own = rules.groupBy(F.coalesce("base", F.lit("")).alias("base")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("number", "line")))).alias("of"))  # an ignore file's lines
        parts = F.split("path", "/")
        above = paths.select("path", "is_dir", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts), F.lit(1)) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("base"))

        def walk_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tries: dict[str, Trie] = {}

            def trie_of(of: str) -> Trie:
                if of not in tries:
                    if len(tries) > 100:
                        tries.clear()
                    base, _, lines = of.partition("\n")
                    tries[of] = Trie([(x["number"], base, x["line"]) for x in json.loads(lines)])
                return tries[of]

            return _last(batches, trie_of)

        met = above.join(own, "base").select("path", "is_dir", F.concat("base", F.lit("\n"), "of").alias("of"))
        some = met.mapInArrow(walk_each, "path string, is_dir boolean, rule long").groupBy("path", "is_dir").agg(F.max("rule").alias("rule"))
        found = paths.join(some, ["path", "is_dir"], "left").select("path", "is_dir", F.coalesce("rule", F.lit(-1).cast("long")).alias("rule"))
    said = rules.select(F.col("number").cast("long").alias("rule"), negated.alias("_negated"))
    return found.join(said, "rule", "left").select("path", "is_dir", F.when(F.col("rule") >= 0, F.col("rule")).alias("rule"), F.coalesce(~F.col("_negated"), F.lit(False)).alias("ignored"))
