"""Licence scan: one Aho-Corasick automaton for identifier tags and notice phrases, and licence expressions by a
shunting-yard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .scratch import small_batches

# Phrases of the base scan and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of the wider scan.
NOTICES = {
    "mit license": "mit",
    "isc license": "isc",
    "bsd license": "bsd",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl-1.0",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0-1.0",
    "public domain": "public-domain",
}
TAG = "spdx license identifier"
TAG_LINE = re.compile(rb"SPDX-License-Identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
TOKENS = re.compile(r"[()]|[A-Za-z0-9.:+-]+")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

#: How freely text under a licence may be used, by identifier, or by its name before the version: only whole names and
#: whole versions fit. Identifiers as they are published.
FREEDOM = {
    "mit": 1.0, "mit-0": 1.0, "x11": 1.0, "isc": 1.0, "0bsd": 1.0, "bsd": 1.0, "zlib": 1.0, "unlicense": 1.0, "wtfpl": 1.0, "bsl-1.0": 1.0, "apache": 1.0, "artistic-2.0": 1.0, "ncsa": 1.0, "postgresql": 1.0, "python-2.0": 1.0, "psf-2.0": 1.0, "upl-1.0": 1.0,
    "cc0": 1.0, "public-domain": 1.0, "cc-by": 0.9, "odc-by-1.0": 0.9, "cc-by-sa": 0.6, "odbl-1.0": 0.6, "gfdl": 0.6, "mpl": 0.6, "epl": 0.6, "cddl": 0.6, "cpl-1.0": 0.6, "ms-pl": 0.6, "ms-rl": 0.6, "eupl": 0.6, "lgpl": 0.6, "gpl": 0.4, "osl-3.0": 0.4, "agpl": 0.3, "sspl-1.0": 0.2,
    "busl-1.1": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1, "reserved": 0.0,
}
UNKNOWN = 0.1
VERSION = re.compile(r"-(?:[0-9]+(?:\.[0-9]+)*|[0-9]-clause)(?:-[a-z]+)*$|-(?:only|or-later)$|\+$")


def freedom(label: str) -> float:
    """By the whole identifier, else by its name without endings and versions, from the last one on."""
    while label not in FREEDOM:
        shorter = VERSION.sub("", re.sub(r"-(?:only|or-later)$|\+$", "", label))
        if shorter == label:
            return UNKNOWN
        label = shorter
    return FREEDOM[label]


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Labels of a licence expression and how freely it lets text be used; None if it is malformed.

    `with` binds closest, then `and`, then `or`. All of `and` must be kept (the strictest counts), one of `or` may be
    chosen (the freest counts), an exception lifts a licence to 0.6 at least.
    """
    values: list[tuple[set[str], float, bool]] = []
    marks: list[str] = []

    def reduce() -> bool:
        if len(values) < 2:
            return False
        op, (right, y, simple), (left, x, single) = marks.pop(), values.pop(), values.pop()
        if op == "with":
            if not (simple and single):
                return False
            values.append(({f"{min(left)}-with-{min(right)}"}, max(x, 0.6), False))
        else:
            values.append((left | right, min(x, y) if op == "and" else max(x, y), False))
        return True

    operand = True
    if TOKENS.sub("", expression).strip():
        return None
    for token in TOKENS.findall(expression):
        name = token.lower()
        if name in PRECEDENCE or token == ")":
            if operand:
                return None
            while marks and marks[-1] != "(" and PRECEDENCE[marks[-1]] >= PRECEDENCE.get(name, 0):
                if not reduce():
                    return None
            if token == ")":
                if not marks:
                    return None
                marks.pop()
            else:
                marks.append(name)
                operand = True
        elif not operand:
            return None
        elif token == "(":
            marks.append("(")
        else:
            values.append(({name}, freedom(name), True))
            operand = False
    while marks:
        if marks[-1] == "(" or not reduce():
            return None
    return values[0][:2] if len(values) == 1 and not operand else None


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE, TAG: None}:
        found.add_word(f" {phrase} ", (phrase, len(phrase) + 2))
    found.make_automaton()
    return found


_PLAIN = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))


def scan(text: bytes, find: ahocorasick.Automaton) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text in UTF-8."""
    every = text.translate(_PLAIN).split()
    flat = f" {b' '.join(every).decode('latin-1')} "
    base, labels, places, at, word, tagged = set(), set(), [], 0, -1, False
    scores = []
    hits = sorted((end - size + 1, phrase) for end, (phrase, size) in find.iter(flat))
    for start, phrase in hits:
        word += flat.count(" ", at, start + 1)
        at = start + 1
        if phrase in BASE:
            places.append(word)
            base.add(BASE[phrase])
        if phrase in NOTICES:
            labels.add(NOTICES[phrase])
        tagged |= phrase == TAG
    scores += [freedom(x) for x in base | labels]
    if tagged:
        lines = TAG_LINE.findall(text)
        # A tag in another form than the published one says nothing that could be relied on.
        scores += [] if lines else [0.0]
        for line in lines:
            expression = re.sub(r"(\*/|-->|[\"'`;,#*]+)\s*$", "", line.decode("utf-8", "replace").strip()).strip()
            if expression and (value := evaluate(expression)):
                labels |= value[0]
                scores.append(value[1])
            else:
                scores.append(0.0)
    return len(every), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), min(scores, default=0.0)


NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())


def _scanned(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = automaton()
    for batch in rows:
        data, at = words.buffers(batch.column("text"))
        found = [scan(data[a:b].tobytes(), find) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        columns = zip(*found, strict=True) if found else [()] * len(NAMES)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, TYPES, strict=True))], ["doc_id", *NAMES])


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id long, text string): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score says how freely the text may be used by the strictest of its notices and tags, 0 to 1; 0 without any, for a
    malformed expression, and for a tag without its colon. Null and empty texts have no words and no labels; repeated rows and null doc_ids are
    returned as they are; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return src.mapInArrow(_scanned, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
