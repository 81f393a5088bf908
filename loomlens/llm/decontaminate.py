"""Benchmark decontamination under edit distance.

Texts and benchmark items are sequences of words (runs of letters, digits and non-ASCII; A-Z lower-cased). An item
leaks into a text that holds a run of words within `1 - similarity` of the item's length in word edits. The CGK random
walk embeds windows of about an item's size so that few edits become few differing coordinates; coordinates sampled
from it, in as many repetitions as the target recall takes, are looked up among the items' own; each window and item
that agree are compared exactly, by edit distance. A window is embedded only if it holds as many word pairs of the
benchmark as a leak must (the q-gram lemma), which loses nothing.

The walks of long items drift apart under their many edits. So an item of more than PIECE words is looked up by its
pieces, of PIECE / 2 to PIECE words: if all of it is within the limit, one of its pieces at least is within the limit
of that piece (the pigeonhole principle). What is compared in the end is the whole item, about where the piece stands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .scratch import small_batches

HOW = words.table(words.NOT_WORD)
#: Items, and bytes of their text, handled in one pass over the texts, an item at least; a larger benchmark takes several.
ITEMS, ITEM_BYTES = 20_000, 8 << 20
#: Words of an item beyond which it is looked up by pieces.
PIECE = 48
#: Coordinates in one sample, and the share of leaks at the limit of edits to find.
SAMPLED, RECALL = 3, 0.99
#: Repetitions tried at once, how often they may be doubled, and leaks simulated for a band. Where the last doubling
#: still finds too few, a band's places are all compared exactly.
REPS, DOUBLINGS, TRIED = 96, 3, 256
#: Lengths of one band differ by this factor at most.
BAND = 1.15
TABLE_BITS = 20


def _walked(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, salts: np.ndarray, coordinates: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(repetition, window, key) of the sampled coordinates of the embeddings of h[start:end], and all keys on the way.

    Step j shows the walk's word (0 past the end) and moves on if a random bit of step and word says so; each sampled
    coordinate is folded into the key. With `among`, a sorted array of the keys that the other side has on its way, a
    window leaves a repetition at the first coordinate that no other side shares.
    """
    reps, n = len(salts), len(starts)
    rep, col = np.repeat(np.arange(reps), n), np.tile(np.arange(n), reps)
    at, end, key = starts[col], ends[col], words._mixed(salts)[rep]
    wide, way = np.append(h, np.uint64(0)), []
    with np.errstate(over="ignore"):
        for j in range(int(coordinates.max(initial=-1)) + 1):
            word = np.where(at < end, wide[np.minimum(at, len(h))], np.uint64(0))
            if (shown := (coordinates == j).any(1)).any():
                now = np.flatnonzero(shown[rep])
                new = words._mixed(key[now] * np.uint64(words.BASE) + word[now])
                key[now] = new
                if among is None:
                    way.append(new)
                else:
                    gone = now[among[np.minimum(np.searchsorted(among, new), len(among) - 1)] != new]
                    keep = np.ones(len(rep), bool)
                    keep[gone] = False
                    rep, col, at, end, key, word = (x[keep] for x in (rep, col, at, end, key, word))
                    if not len(rep):
                        break
            bits = words._mixed(salts + np.uint64(j + 1))[rep]
            at = at + (((word ^ bits) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63)).astype(np.int64)
    return rep, col, key, np.unique(np.concatenate(way)) if way else np.zeros(0, np.uint64)


def _cuts(n: int) -> list[tuple[int, int]]:
    """Where the pieces of an item of n words begin and end: as few as have PIECE words at most, about equally long."""
    m = -(-n // PIECE)
    return [(i * n // m, (i + 1) * n // m) for i in range(m)]


def _passes(items: DataFrame) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and texts of items, as many at a time as one pass takes."""
    ids, texts, size = [], [], 0
    for i, text in items.toLocalIterator():
        if ids and (len(ids) == ITEMS or size + len(text) > ITEM_BYTES):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(bytes(text))
        size += len(text)
    if ids:
        yield ids, texts


def edits(item: np.ndarray, text: np.ndarray) -> int:
    """The least number of word edits between item and any run of text, by bit-parallel columns."""
    m = len(item)
    if not m:
        return 0
    mask: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        mask[w] = mask.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    rise, fall, score, best = full, 0, m, m
    for w in text.tolist():
        eq = mask.get(w, 0)
        across = (((eq & rise) + rise) ^ rise) | eq
        up, down = fall | (~(across | rise) & full), rise & across
        score += (up & top > 0) - (down & top > 0)
        up, down, eq = (up << 1) & full, (down << 1) & full, eq | fall
        rise, fall = down | (~(eq | up) & full), up & eq
        best = min(best, score)
    return best


class Index:
    """Items of one pass, by bands of the length of their pieces."""

    def __init__(self, ids: list[int], texts: list[bytes], similarity: float, recall: float, seed: int = 11, doublings: int = DOUBLINGS) -> None:
        column = pa.array(texts, pa.binary())
        data, offsets = words.buffers(column)
        h, at = words.hashed(data, offsets, HOW)
        kept = [(i, h[a:b]) for i, a, b in zip(ids, at[:-1], at[1:], strict=True) if b > a]
        self.ids, self.items = [x[0] for x in kept], [x[1] for x in kept]
        allowed = lambda x: math.floor((1 - similarity) * len(x) + 1e-9)
        self.allowed = [allowed(x) for x in self.items]
        self.doublings = doublings
        # Pieces by length: the words, the edits they may have, the item and where in it they begin.
        cut = [(x[lo:hi], k, lo) for k, x in enumerate(self.items) for lo, hi in _cuts(len(x))]
        cut.sort(key=lambda x: (len(x[0]), x[1], x[2]))
        self.pieces, self.of, self.offset = [x[0] for x in cut], np.array([x[1] for x in cut], np.int64), np.array([x[2] for x in cut], np.int64)
        self.may = [allowed(x) for x in self.pieces]
        self.pairs = np.zeros(1 << TABLE_BITS, bool)
        self.bands = []
        rng = np.random.default_rng(seed)
        for x in self.pieces:
            self.pairs[(words.grams(x, 2) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        i = 0
        while i < len(self.pieces):
            low = len(self.pieces[i])
            j = next((j for j in range(i, len(self.pieces)) if len(self.pieces[j]) > max(low, low * BAND)), len(self.pieces))
            self.bands.append(self._band(range(i, j), rng, recall))
            i = j

    def _band(self, members: range, rng: np.random.Generator, recall: float) -> dict:
        short, long = len(self.pieces[members[0]]), len(self.pieces[members[-1]])
        h, ends = np.concatenate([self.pieces[k] for k in members]), np.cumsum([len(self.pieces[k]) for k in members])
        starts = ends - [len(self.pieces[k]) for k in members]
        tried = rng.choice(len(members), TRIED)
        changed = [self._edited(self.pieces[members[k]], self.may[members[k]], rng) for k in tried]
        words2, ends2 = np.concatenate(changed), np.cumsum([len(x) for x in changed])
        starts2 = ends2 - [len(x) for x in changed]
        salts, coordinates, keys, agree = [], [], [], []
        for doubling in range(self.doublings + 1):
            n = REPS << max(0, doubling - 1)
            salt = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            # About two steps show a word. Near the end some walks are over, which says little about what was walked.
            at = np.sort(rng.integers(0, max(1, 3 * short // 2), (n, SAMPLED)), 1)
            key = _walked(h, starts, ends, salt, at)[2].reshape(n, -1)
            agree.append(_walked(words2, starts2, ends2, salt, at)[2].reshape(n, -1) == key[:, tried])
            for x, y in ((salts, salt), (coordinates, at), (keys, key)):
                x.append(y)
            found = np.logical_or.accumulate(np.concatenate(agree), 0).mean(1) >= recall
            if found.any():
                break
        reps = int(np.argmax(found)) + 1 if found.any() else 0
        salts, coordinates, keys = (np.concatenate(x)[:reps] for x in (salts, coordinates, keys))
        flat, piece = keys.ravel(), np.tile(np.arange(members.start, members.stop), reps)
        order = np.argsort(flat, kind="stable")
        way = _walked(h, starts, ends, salts, coordinates)[3]
        most = max(self.may[k] for k in members)
        least = min(len(self.pieces[k]) - 1 - 2 * self.may[k] for k in members)
        return {"members": members, "long": long, "window": long + most, "least": least, "short": max(1, short - self.may[members[0]]), "salts": salts, "coordinates": coordinates, "way": way, "keys": flat[order], "piece": piece[order]}

    @staticmethod
    def _edited(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
        for _ in range(n):
            k, kind = int(rng.integers(len(x))), rng.integers(3)
            new = rng.integers(1, 1 << 63, 1, dtype=np.uint64)
            x = np.concatenate([x[:k], new if kind < 2 else new[:0], x[k + (kind != 1) :]])
        return x

    def found(self, h: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(text, position of the item) for each leak among texts whose words are h[at[i]:at[i + 1]]."""
        out: set[tuple[int, int]] = set()
        if not len(h) or not self.items:
            return out
        pair = self.pairs[(words.grams(h, 2) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        inner = at[1:-1]
        inner = inner[(inner > 0) & (inner < len(h))]
        pair[inner - 1] = False  # of two texts
        run = np.zeros(len(h) + 1, np.int32)
        np.cumsum(pair, out=run[1 : len(h)])
        run[len(h)] = run[len(h) - 1]
        place = np.arange(len(h))
        for band in self.bands:
            if band["least"] > 0:
                w = band["window"]
                # Pairs from a place to the end of a window; pairs of a later text in it only let more pass.
                n = run[np.minimum(place + w - 1, len(h) - 1)] - run[:-1]
                p = np.flatnonzero(n >= band["least"])
            else:
                p = place
            if not len(p):
                continue
            text = np.searchsorted(at, p, "right") - 1
            ok = at[text + 1] - p >= band["short"]
            p, text = p[ok], text[ok]
            for lo in range(0, len(p), 1 << 14):
                q, d = p[lo : lo + (1 << 14)], text[lo : lo + (1 << 14)]
                if not len(band["salts"]):
                    for k in band["members"]:
                        self._verified(out, h, at, d, np.full(len(q), k), q)
                    continue
                _, col, key, _ = _walked(h, q, np.minimum(q + band["long"], at[d + 1]), band["salts"], band["coordinates"], band["way"])
                a, b = np.searchsorted(band["keys"], key), np.searchsorted(band["keys"], key, "right")
                n = b - a
                if n.sum():
                    piece = band["piece"][np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    self._verified(out, h, at, np.repeat(d[col], n), piece, np.repeat(q[col], n))
        return out

    def _verified(self, out: set[tuple[int, int]], h: np.ndarray, at: np.ndarray, text: np.ndarray, piece: np.ndarray, start: np.ndarray) -> None:
        """Adds to out the texts and items where pieces that seem to start somewhere are part of a leak of their item.

        Starts of an item that are near each other are verified at once, over all that any of them could reach.
        """
        item = self.of[piece]
        begin = start - self.offset[piece]
        size = np.array([max(PIECE, len(x) // 2) for x in self.items], np.int64)[item]
        near = np.stack([text, item, begin // size], 1)
        for doc, k, block in np.unique(near, axis=0).tolist():
            if (doc, k) in out:
                continue
            x, most, wide = self.items[k], self.allowed[k], max(PIECE, len(self.items[k]) // 2)
            low, high = block * wide - most, (block + 1) * wide + len(x) + most
            if edits(x, h[max(int(at[doc]), low) : max(0, min(int(at[doc + 1]), high))]) <= most:
                out.add((doc, k))


def _leaks(rows: Iterator[pa.RecordBatch], index, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Adds the items of one pass to item_ids."""
    ix = index.value
    for batch in rows:
        items = [x or [] for x in batch.column("item_ids").to_pylist()]
        for i, h, at in words.batches(batch.column("text"), HOW):
            for doc, k in ix.found(h, at):
                items[i + doc].append(ix.ids[k])
        found = pa.array([sorted(set(x)) for x in items], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([found if n == "item_ids" else batch.column(n) for n in schema.names], schema.names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = RECALL) -> DataFrame:
    """Per row of docs (doc_id long, text string): doc_id, n_items, item_ids (the benchmark's items in it, ascending).

    benchmark has item_id long and text string. Null and empty texts hold nothing, and items without words are held by
    nothing; items of under 5 words are found where they stand word for word. Repeated items and rows count by id;
    null item ids are left out, null doc_ids are returned. An empty benchmark gives empty lists. Other columns are
    ignored. Each text is read whole; a leak at the limit of edits, of an item of any length, is found with a chance of
    about `recall` or more, one with fewer edits nearly always, and nothing beyond the limit is reported.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null")
    out = out.withColumn("item_ids", F.expr("cast(array() as array<bigint>)"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("item_ids", pa.list_(pa.int64()))])
    for block in _passes(items):
        index = spark.sparkContext.broadcast(Index(*block, similarity, recall))
        out = out.mapInArrow(partial(_leaks, index=index, schema=schema), "doc_id long, text binary, item_ids array<long>")
    return out.select("doc_id", F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def _clean(rows: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    ix = index.value
    for batch in rows:
        keep = np.ones(len(batch), bool)
        for i, h, at in words.batches(batch.column("text"), HOW):
            for doc, _ in ix.found(h, at):
                keep[i + doc] = False
        yield batch.filter(pa.array(keep))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = RECALL) -> DataFrame:
    """The rows of docs whose text holds no item of benchmark, with all their columns. Null texts hold none."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null")
    small_batches(spark)
    out = docs
    for block in _passes(items):
        index = spark.sparkContext.broadcast(Index(*block, similarity, recall))
        out = out.mapInArrow(partial(_clean, index=index), docs.schema)
    return out
