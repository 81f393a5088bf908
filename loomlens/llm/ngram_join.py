"""Exact Jaccard join of documents on word n-grams, by set relations.

Every text is a set of n-gram hashes. Equal sets are one class. The sets' elements are ordered by how often their
counting bucket occurs in the corpus, so that the first elements of a set, of which two similar sets share one, are
rare. Those prefixes make an inverted index whose lists are sorted by set size and position:

* index-level skipping: a list is read as blocks of one size; a block is skipped whole where its size, or its lowest
  position, leaves room for too small an intersection. A parity bitmap of each set, whose differing bits can't
  outnumber the sets' differing elements, rejects most of what is left;
* answer-level skipping: within a list a set is compared with the list's hubs (sets without a similar hub), not with
  all. What two sets differ in from a hub they were both verified against gives their intersection without reading
  either set, and sets that are already connected are not compared at all.

Rows stay in proportion to the index: a list of n similar sets gives about n pairs, not n * n. What hubs leave apart is
first offered its nearest set of another label in each list, a row an entry at most, and connected by what proves
similar; only sets of labels that are still apart are then all compared. Lists of more than HOT entries are dealt out:
twice over random parts for hubs and nearest sets, then, where sets of more than one label are left, over cells, so that
each two parts of the list meet in one.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .graph import components
from .scratch import freeing, small_batches, written

#: Counting buckets for the order of elements: 2**BUCKET_BITS counters, whatever the corpus.
BUCKET_BITS = 18
CHUNKS = 16
#: Bits of a set's parity bitmap: the least power of 2 from BITS to MOST_BITS that a set of its size does not crowd.
BITS, MOST_BITS = 512, 4096
#: Sets of more elements than LONG also have one of WIDE bits; it stays out of the index.
LONG, WIDE = 1500, 8192
#: Which pairs of a list are made: sets with hubs; sets with their nearest of another label; all of different labels.
HUBS, NEAREST, ALL = "hubs", "nearest", "all"
#: Rounds of nearest sets at most; what they leave apart is compared in full.
ROUNDS = 2
#: Entries of an index list, about, that one task compares.
HOT = 1000
#: Pairs and labels (some 24 bytes each) are broadcast up to this many, else joined by shuffle.
BROADCAST_ROWS = 250_000
#: Bits of the filter of set ids that a pass over the texts carries, as a power of 2: about 16 for an id, within bounds.
#: 16 MB at most, however many ids; a crowded filter lets sets through that a later join drops.
FILTER_LEAST, FILTER_MOST = 18, 27
HOW = words.table(words.WHITE)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, h, at in words.batches(batch.column("text"), HOW):
        for row, s in enumerate(words.shingles(h, at, k), i):
            yield row, s


def _sid(s: np.ndarray) -> int:
    """A set's id: a signed 64-bit digest of its sorted elements."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _need(n: np.ndarray | int, m: np.ndarray | int, t: Fraction):
    """The least intersection of sets of n and m elements with Jaccard similarity t or more."""
    p, q = t.numerator, t.numerator + t.denominator
    return -((-p * (n + m)) // q)


def _prefix(n: int, t: Fraction) -> int:
    return n - -((-t.numerator * n) // t.denominator) + 1


def _signed(rows: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each document's set id and size; at the end the partition's counts of elements by bucket, in chunks."""
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in rows:
        sid, n, buckets = [0] * len(batch), np.zeros(len(batch), np.int64), []
        for row, s in _sets(batch, k):
            n[row] = len(s)
            if len(s):
                sid[row] = _sid(s)
                buckets.append((s >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        if buckets:
            counts += np.bincount(np.concatenate(buckets), minlength=len(counts))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), pa.array(sid, pa.int64(), mask=n == 0), pa.array(n), pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.binary())],
            ["doc_id", "digest", "sid", "n", "chunk", "counts"],
        )
    if counts.any():
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(CHUNKS, pa.int64())] * 4, pa.array(range(CHUNKS), pa.int32()), pa.array([x.tobytes() for x in np.split(counts, CHUNKS)], pa.binary())],
            ["doc_id", "digest", "sid", "n", "chunk", "counts"],
        )


def _summed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in rows:
        for chunk, x in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
            total[chunk] = total.get(chunk, 0) + np.frombuffer(x.as_py(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])


def _indexed(rows: Iterator[pa.RecordBatch], k: int, t: Fraction, counts) -> Iterator[pa.RecordBatch]:
    """The index entries of each set that this partition sees for the first time: element, set, size, position."""
    seen: set[int] = set()
    often = counts.value
    for batch in rows:
        out: list[list] = [[], [], [], []]
        for _, s in _sets(batch, k):
            if not len(s) or (sid := _sid(s)) in seen:
                continue
            seen.add(sid)
            p = _prefix(len(s), t)
            first = s[np.lexsort((s, often[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))[:p]]
            for column, x in zip(out, (first.view(np.int64), np.full(p, sid), np.full(p, len(s), np.int32), np.arange(p, dtype=np.int32)), strict=True):
                column.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["token", "sid", "n", "pos"])


def _shared(rows: Iterator[pa.RecordBatch], t: Fraction) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by element and size, those with a neighbour in the list of another id and a fitting size."""
    last = None
    for batch in rows:
        cols = [np.asarray(batch.column(x)) for x in ("token", "sid", "n", "pos")]
        if last is not None:
            cols = [np.concatenate(x) for x in zip(last[:4], cols, strict=True)]
        token, sid, n = cols[:3]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1]) | (n[1:] != n[:-1])
        cols = [x[new] for x in cols]
        token, sid, n = cols[:3]
        fits = (token[1:] == token[:-1]) & (t.denominator * n[:-1].astype(np.int64) >= t.numerator * n[1:].astype(np.int64))
        keep = np.zeros(len(token), bool)
        keep[1:] |= fits
        keep[:-1] |= fits
        if last is not None:
            keep[0] |= last[4]
        last = [x[-1:] for x in cols] + [bool(keep[-1])]
        keep[-1] = False
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in cols], ["token", "sid", "n", "pos"])
    if last is not None and last[4]:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last[:4]], ["token", "sid", "n", "pos"])


def _bitmap(s: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bit i: the parity of the number of elements that fall on i."""
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1)


def _width(n: int) -> int:
    """Bits for the bitmap of a set of n elements: unlike sets of fewer than 1.8 elements a bit differ in more bits than
    similar ones can."""
    bits = BITS
    while bits < MOST_BITS and 9 * bits < 5 * n:
        bits *= 2
    return bits


def _noted(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The part of the filter for ids that begin with the same four bits."""
    parts: dict[int, np.ndarray] = {}
    for batch in rows:
        at = np.asarray(batch.column("sid")).view(np.uint64) >> np.uint64(64 - size)
        for chunk in np.unique(at >> np.uint64(size - 4)).tolist():
            bits = parts.setdefault(chunk, np.zeros(1 << (size - 4), bool))
            bits[(at[at >> np.uint64(size - 4) == chunk] & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([np.packbits(x).tobytes() for x in parts.values()], pa.binary())], ["chunk", "bits"])


def _id_filter(ids: DataFrame):
    """A broadcast bitmap that holds all ids (sid); to be destroyed after use."""
    ids = written(ids.select("sid").distinct(), "ids")
    size = min(FILTER_MOST, max(FILTER_LEAST, (16 * ids.count()).bit_length()))
    chunks = ids.repartition(16, F.shiftrightunsigned("sid", 60)).mapInArrow(partial(_noted, size=size), "chunk int, bits binary")
    found = np.zeros((16, 1 << (size - 7)), np.uint8)
    for chunk, bits in chunks.collect():  # 16 rows of a fixed size at most
        found[chunk] = np.frombuffer(bits, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(found.ravel())


def _wanted(rows: Iterator[pa.RecordBatch], k: int, wanted) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The sets that the filter holds, with their ids, each once in a partition."""
    held, seen = wanted.value, set()
    size = (8 * len(held)).bit_length() - 1
    for batch in rows:
        out = []
        for _, s in _sets(batch, k):
            if len(s) and (sid := _sid(s)) not in seen:
                at = (sid & (1 << 64) - 1) >> (64 - size)
                if held[at >> 3] >> (7 - (at & 7)) & 1:
                    seen.add(sid)
                    out.append((sid, s))
        if out:
            yield out


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]).astype(np.int32)), pa.array(np.concatenate(arrays).view(np.int64)))


def _bitmaps(rows: Iterator[pa.RecordBatch], k: int, wanted) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.int64)
    for out in _wanted(rows, k, wanted):
        wide = _lists([_bitmap(s, WIDE).view(np.int64) if len(s) > LONG else none for _, s in out])
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([len(s) for _, s in out], pa.int64()), pa.array([_bitmap(s, _width(len(s))).tobytes() for _, s in out], pa.binary()), wide], ["sid", "n", "bits", "wide"])


def _elements(rows: Iterator[pa.RecordBatch], k: int, wanted) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for out in _wanted(rows, k, wanted):
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([part] * len(out), pa.int32()), _lists([s for _, s in out])], ["sid", "part", "items"])


class _Blocks:
    """The part of one index list that later entries are compared with, in blocks of one set size."""

    def __init__(self, t: Fraction) -> None:
        self.t, self.size, self.low, self.rows = t, [], [], []

    def add(self, n: int, pos: int, row: tuple) -> None:
        if not self.size or self.size[-1] != n:
            self.size.append(n)
            self.low.append(pos)
            self.rows.append([])
        self.low[-1] = min(self.low[-1], pos)
        self.rows[-1].append(row)

    def similar(self, n: int, pos: int, bits: np.ndarray) -> list[tuple]:
        """Rows (sid, pos, bits, label) that may be similar to a set of n elements with this one at pos, each with the
        share of elements, or less, in which they differ. The bitmap of n is as wide as theirs or wider, and folded."""
        t, found = self.t, []
        for b in range(len(self.size) - 1, -1, -1):
            m = self.size[b]
            if t.denominator * m < t.numerator * n:  # sizes only fall from here
                break
            need = _need(n, m, t)
            if min(m - self.low[b], n - pos) < need:
                continue
            rows = [x for x in self.rows[b] if m - x[1] >= need]
            if rows:
                theirs = np.stack([x[2] for x in rows])
                apart = np.bitwise_count(theirs ^ np.bitwise_xor.reduce(bits.reshape(-1, theirs.shape[1]))).sum(1)
                found += [(x, d / (n + m)) for x, d in zip(rows, apart.tolist(), strict=True) if d <= n + m - 2 * need]
        return found


def _offered(nearest: dict[int, tuple], labels: dict[int, int]) -> list[tuple[int, int]]:
    """The nearest pairs of a list's sets, less those that sets of its most frequent label would offer."""
    main = max(labels, key=lambda x: (labels[x], x)) if labels else None
    return sorted({pair for _, pair, label in nearest.values() if label != main})


def _compared(rows: Iterator[pa.RecordBatch], t: Fraction, how: str) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of sets to verify, from entries sorted by element, part of its list, size, position and id.

    HUBS: each set against the part's hubs. ALL: sets against all earlier ones of the part with another label. NEAREST:
    of those pairs, for each set the one with the fewest differing bits for its size.
    """
    now, blocks, last = None, None, None
    labels: dict[int, int] = {}
    nearest: dict[int, tuple] = {}
    for batch in rows:
        token, part, sid, n, pos, bits = (batch.column(x).to_pylist() for x in ("token", "part", "sid", "n", "pos", "bits"))
        label = sid if how == HUBS else batch.column("label").to_pylist()
        out: list[tuple[int, int]] = []
        for i, key in enumerate(zip(token, part, strict=True)):
            if key != now:
                out += _offered(nearest, labels)
                now, blocks, labels, nearest = key, _Blocks(t), {}, {}
                last = None
            if last == (sid[i], n[i]):
                continue
            last = (sid[i], n[i])
            own = np.frombuffer(bits[i], np.uint64)
            found = blocks.similar(n[i], pos[i], own) if blocks.size and (how == HUBS or labels.keys() != {label[i]}) else []
            if how != HUBS:
                labels[label[i]] = labels.get(label[i], 0) + 1
                found = [x for x in found if x[0][3] != label[i]]
            if how == NEAREST:
                for x, d in found:
                    offer = (d, (x[0], sid[i]))
                    for one, its in ((x[0], x[3]), (sid[i], label[i])):
                        if one not in nearest or offer < nearest[one][:2]:
                            nearest[one] = (*offer, its)
            else:
                out += [(x[0], sid[i]) for x, _ in found]
            if how != HUBS or not found:
                blocks.add(n[i], pos[i], (sid[i], pos[i], own, label[i]))
        if out:
            yield _both(out)
    if out := _offered(nearest, labels):
        yield _both(out)


def _both(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], ["a", "b"])


def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it was counted to be small enough."""
    return F.broadcast(df) if df.count() <= most else df


def _pairs(parts: DataFrame, bits: DataFrame, t: Fraction, how: str) -> DataFrame:
    """(a, b) to verify, written, from entries with the part of a list that they are in. Bitmaps go with the entries in
    one shuffle only, whose files go at once."""
    with freeing(parts.sparkSession):
        laid = parts.join(bits, "sid").repartition("token", "part").sortWithinPartitions("token", "part", "n", "pos", "sid")
        return written(laid.mapInArrow(partial(_compared, t=t, how=how), "a long, b long").distinct(), "pairs")


def _dealt(listed: DataFrame) -> DataFrame:
    """Entries with a part of their list: the only one, or two random ones of a long list's, from two deals."""
    of = lambda deal: F.pmod(F.xxhash64("token", "sid", F.lit(deal)), F.col("parts")) + deal * F.col("parts")
    return listed.withColumn("part", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array(of(0), of(1)))))


def _cells(labelled: DataFrame) -> DataFrame:
    """Entries with the parts of their list in which each two of different labels meet.

    A long list's most frequent label is the main one. Its m parts meet the s parts of the others in m * s cells; the
    others' parts meet each other in more cells. Others that fit one part thus cost about as many rows as the list has.
    """
    long = labelled.where("parts > 1")
    by = long.groupBy("token", "label").count().groupBy("token")
    by = by.agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.max("count").alias("most"), F.sum("count").alias("all")).where("all > most")
    by = written(by.select("token", "main", F.ceil(F.col("most") / HOT).alias("m"), F.ceil((F.col("all") - F.col("most")) / HOT).alias("s")), "mixed")
    rows = long.join(_small(by), "token").withColumn("is_main", F.col("label") == F.col("main"))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("token", "sid"), F.when(F.col("is_main"), F.col("m")).otherwise(F.col("s"))))
    upto = lambda n, cell: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), cell)
    cell = lambda part, label: F.struct(part.alias("part"), label.cast("long").alias("label"))
    h, m, s, label = F.col("h"), F.col("m"), F.col("s"), F.col("label")
    main = upto("s", lambda j: cell(h * s + j, F.lit(0)))
    other = F.concat(upto("m", lambda i: cell(i * s + h, F.lit(1))), upto("s", lambda j: cell((m + F.least(h, j)) * s + F.greatest(h, j), label)))
    rows = rows.select("token", "sid", "n", "pos", F.inline(F.when(F.col("is_main"), main).otherwise(other)))
    return labelled.where("parts = 1").select("token", "sid", "n", "pos", F.lit(0).cast("long").alias("part"), "label").unionByName(rows)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with how many elements each has, and the elements that only one of them has.

    sets may hold a set once for each partition that has it; the first such row is used. Elements move once: those of
    b to the rows of a.
    """
    one = sets.groupBy("sid").agg(F.min("part").alias("part"))
    b = _small(written(pairs.join(one.withColumnRenamed("sid", "b"), "b"), "places"))
    a = _small(written(pairs.select(F.col("a").alias("sid")).distinct().join(one, "sid"), "hubs"))
    left = sets.join(a, ["sid", "part"]).select(F.col("sid").alias("a"), F.col("items").alias("x"))
    right = sets.withColumnRenamed("sid", "b").join(b, ["b", "part"]).select("a", "b", F.col("items").alias("y"))
    both = right.join(left.hint("merge"), "a")
    both = both.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("differ"))
    # What differs is kept where it is short enough to derive other answers from.
    return both.select("a", "b", "n", "m", F.size("differ").alias("d"), F.when(F.size("differ") * 8 <= F.col("n") + F.col("m"), F.col("differ")).alias("differ"))


def _plausible(pairs: DataFrame, bitmaps: DataFrame, t: Fraction) -> DataFrame:
    """Pairs less those of long sets whose wide bitmaps differ in more bits than similar sets' elements can."""
    of = lambda x: bitmaps.where(f"n > {LONG}").select(F.col("sid").alias(x), F.col("n").alias(f"{x}_n"), F.col("wide").alias(f"{x}_wide"))
    both = _small(pairs).join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = F.aggregate(F.zip_with("a_wide", "b_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return both.withColumn("d", apart).where(F.coalesce(F.expr(_linked("a_n", "b_n", "d", t)), F.lit(True))).select("a", "b")


def _linked(n: str, m: str, differ, t: Fraction):
    """Whether sets of n and m elements that differ in so many have similarity t or more."""
    return f"{t.denominator} * ({n} + {m} - ({differ})) >= {t.numerator} * ({n} + {m} + ({differ}))"


def _digest(text: Column) -> Column:
    return F.xxhash64(text.cast("binary"))


def _grouped(docs: DataFrame, k: int, similarity: Fraction) -> tuple[DataFrame, DataFrame]:
    """signed (doc_id, digest, sid, n), a row for each of docs; and of the sets that links connect (sid, set), set being
    the same for all that reach each other."""
    spark, t = docs.sparkSession, Fraction(similarity)
    small_batches(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    marked = text.withColumn("digest", _digest(F.col("text")))
    signed = written(marked.mapInArrow(partial(_signed, k=k), "doc_id long, digest long, sid long, n long, chunk int, counts binary"), "signed")
    sums = signed.where("chunk is not null").select("chunk", "counts").repartition(CHUNKS, "chunk").mapInArrow(_summed, "chunk int, counts binary")
    counts = np.zeros((CHUNKS, (1 << BUCKET_BITS) // CHUNKS), np.int64)
    for chunk, x in sums.collect():  # CHUNKS rows of a fixed size
        counts[chunk] = np.frombuffer(x, np.int64)
    shared_counts = spark.sparkContext.broadcast(counts.ravel())
    signed = signed.where("chunk is null").select("doc_id", "digest", "sid", "n")

    entries = written(text.select("text").mapInArrow(partial(_indexed, k=k, t=t, counts=shared_counts), "token long, sid long, n int, pos int"), "entries")
    shared_counts.destroy()
    long = written(entries.groupBy("token").count().where(F.col("count") > HOT).select("token", F.ceil(F.col("count") / HOT).alias("parts")), "long")
    long = _small(long)
    rest = entries.join(long, "token", "left_anti").repartition("token").sortWithinPartitions("token", "n", "pos", "sid")
    rest = rest.mapInArrow(partial(_shared, t=t), "token long, sid long, n int, pos int").withColumn("parts", F.lit(1).cast("long"))
    lists = written(rest.unionByName(entries.join(long, "token").distinct()), "lists")

    def looked_up(ids: DataFrame, how, schema: str) -> DataFrame:
        wanted = _id_filter(ids)
        out = written(text.select("text").mapInArrow(partial(how, k=k, wanted=wanted), schema), "sets")
        wanted.destroy()
        return out

    bitmaps = looked_up(lists, _bitmaps, "sid long, n long, bits binary, wide array<long>").dropDuplicates(["sid"])
    bitmaps = written(bitmaps, "bitmaps")
    bits = _small(bitmaps.select("sid", "bits"), BROADCAST_ROWS // 4)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(_plausible(pairs, bitmaps, t), "plausible")
        ids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b"))
        return _verified(pairs, looked_up(ids, _elements, "sid long, part int, items array<long>"))

    tested = _pairs(_dealt(lists), bits, t, HUBS)
    answers = written(verified(tested), "answers")
    good = _linked("n", "m", "d", t)
    linked = answers.where(good).select("a", "b")
    label = written(components(linked).select(F.col("node").alias("sid"), F.col("component").alias("label")), "labels")
    known_links = lambda: label.where("sid <> label").select(F.col("sid").alias("a"), F.col("label").alias("b"))

    def relabelled() -> DataFrame:
        return lists.join(_small(label), "sid", "left").withColumn("label", F.coalesce("label", "sid"))

    # What hubs left apart and its nearest set connects.
    for _ in range(ROUNDS):
        offered = written(_pairs(_dealt(relabelled()), bits, t, NEAREST).join(tested, ["a", "b"], "left_anti"), "offered")
        if offered.head() is None:
            break
        linked = written(verified(offered).where(good).select("a", "b"), "linked")
        tested = tested.unionByName(offered)
        if linked.head() is None:
            break
        label = written(components(known_links().union(linked)).select(F.col("node").alias("sid"), F.col("component").alias("label")), "labels")

    # All of what is still apart. Lists whose sets are all connected give nothing.
    pairs = written(_pairs(_cells(relabelled()), bits, t, ALL).join(tested, ["a", "b"], "left_anti"), "pairs")
    hub = answers.where("differ is not null").groupBy("b").agg(F.min_by(F.struct("a", "m", "differ"), F.struct(F.size("differ"), "a")).alias("h"))
    near = hub.select(F.col("b").alias("sid"), "h.*")
    own = answers.where("differ is not null").select(F.col("a").alias("sid"), "a", F.col("n").alias("m"), F.expr("cast(array() as array<bigint>)").alias("differ")).dropDuplicates(["sid"])
    near = near.unionByName(own.join(near.select("sid"), "sid", "left_anti"))
    of = lambda x: near.select(F.col("sid").alias(x), F.col("a").alias(f"{x}_hub"), F.col("m").alias(f"{x}_n"), F.col("differ").alias(f"{x}_differ"))
    derived = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    known = derived.where("a_hub = b_hub").where(_linked("a_n", "b_n", "size(a_differ) + size(b_differ) - 2 * size(array_intersect(a_differ, b_differ))", t)).select("a", "b")
    rest = written(derived.where("not (a_hub <=> b_hub) or a_hub is null").select("a", "b"), "rest")
    more = known.union(verified(rest).where(good).select("a", "b")) if rest.head() else known
    return signed, components(known_links().union(more)).select(F.col("node").alias("sid"), F.col("component").alias("set"))


def ngram_jaccard_join(docs: DataFrame, k: int = 3, similarity: Fraction = Fraction(9, 10)) -> DataFrame:
    """Per row of docs (doc_id long, text string): doc_id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z lower-cased; elements are distinct k-word shingles, the whole
    sequence where there are fewer words. component_id is the smallest doc_id reachable by links of similarity
    `similarity` or more, exactly. Null, empty and blank texts have no elements, link with nothing and are their own
    component. Repeated rows each return a row; rows that repeat a doc_id link as their texts do. A row with a null
    doc_id is returned; it takes part through other rows of the same set, else its component is null. Empty tables give empty results; columns other
    than doc_id and text are ignored, whatever their names.
    """
    signed, groups = _grouped(docs, k, similarity)
    least = signed.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"))
    least = least.join(groups, "sid", "left").withColumn("set", F.coalesce("set", "sid"))
    low = least.groupBy("set").agg(F.min("least").alias("component_id"))
    # Written, so that both sides of the join are plain shuffles, of which adaptive execution splits a set with many copies.
    classes = written(least.join(low, "set").select("sid", "component_id"), "classes")
    return signed.join(classes, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of docs less near duplicates, with all their columns: of the rows that links connect, as in
    ngram_jaccard_join, the one with the smallest doc_id stays, null last; then the one with the smallest digest of its
    text; of rows equal in both one stays, the least by its other columns.

    Rows without elements (null, empty and blank texts) are nobody's duplicates and all stay. Rows are told apart by
    doc_id and digest together, so unlike texts that share a doc_id, or have none, are judged each on its own. Columns
    must be of types that can be ordered.
    """
    signed, groups = _grouped(docs, k, similarity)
    signed = signed.where("sid is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    first = signed.groupBy("sid").agg(F.min(rank).alias("r")).join(groups, "sid", "left").groupBy(F.coalesce("set", "sid")).agg(F.min("r").alias("r"))
    first = first.select(F.col("r.doc_id").alias("first_id"), F.col("r.digest").alias("first_digest"))
    each = signed.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    each = each.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest")), "left")
    # Only what goes, or stays once of several equal rows, is looked up among the texts.
    marks = each.where("first_digest is null or n > 1").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("first_digest").isNotNull().alias("_once"))
    marks = written(marks, "marks")
    found = docs.join(_small(marks), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (_digest(F.col("text")) == F.col("_digest")), "left")
    stay = found.where("_once is null").select(*docs.columns)
    if marks.where("_once").head() is None:
        return stay
    once = found.where("_once").groupBy("_id", "_digest").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return stay.unionByName(once)
