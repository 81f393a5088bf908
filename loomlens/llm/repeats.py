"""Passages that stand in several documents, by suffix arrays over what may repeat.

A string of `least` bytes holds an anchor: the 20-byte run in it whose hash is smallest. Equal strings have equal anchors,
and around the anchor they share half of what is left of the string, before it or after it. So only anchors that stand
twice with such an arm can lie in a repeat. First, hashes of anchors and of their arms are counted, dealt out by their
leading bits; the answer is a filter of fixed size, which saturates on a huge corpus but never loses an anchor, and the
list of hot anchors, at most about a million by definition. Then each anchor that passes goes, with the bytes around it, to the task
of its hash. There an enhanced suffix array over those bytes is scanned with a stack: its common-prefix intervals with
more than one left extension are the maximal repeats, each with all its occurrences, and every occurrence outside the
group's smallest document is a passage to remove. Strings that reach over several anchors are put together by document.

The suffixes of one hot anchor might not fit a task. For these, equal surroundings are first brought down to one row
that stands for all, and then each of its strings of `least` bytes is a key of its own, brought down to the smallest
document before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch, words

GRAM = 20
#: Bytes worked on at once; longer texts are cut into pieces that overlap by a string less one byte.
SLICE = 1 << 20
#: Bits of the filter of what stands twice, and hashes that a counting group has at most, about.
FILTER, GROUP = 28, 1 << 19
#: An anchor is hot from so many occurrences on, and from one in so many of all on, so that hot ones are a bounded list.
HOT, HOT_SHARE = 1000, 1 << 20
#: Rows that a suffix array is built over at once, but for the end of the last anchor's.
ROWS = 20_000
_VALUE = words.table(b"", fold=False)[1]


def _sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """op over each run of width values."""
    done = 1
    while done * 2 <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What gives the hash of data[a:b]: (run[b] - run[a]) * down[a], mixed."""
    up, down = words._power(len(data))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=run[1:])
    return run, down


def _pieces(offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as (row, begin, end) in the buffer: each string of `least` bytes lies in exactly one piece."""
    strings = np.maximum(np.diff(offsets) - (least - 1), 0)
    times = -(-strings // SLICE)
    row = np.repeat(np.arange(len(strings)), times)
    lo = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)) * SLICE
    return row, lo, np.minimum(lo + SLICE, offsets[row] + strings[row]) + least - 1


class Anchors:
    """The anchors of a slice of texts: key, keys with an arm before and after (0 where the text doesn't reach so far),
    hash of the surroundings (snippet), row, place in the text, and where the surroundings begin and end in data; the
    anchor is `lead` bytes into them."""

    def __init__(self, data: np.ndarray, at: np.ndarray, row: np.ndarray, base: np.ndarray, least: int) -> None:
        self.data = data
        span = least - GRAM + 1
        with np.errstate(over="ignore"):
            run, down = _runs(data)
            h = words._mixed((run[GRAM:] - run[:-GRAM]) * down[: len(data) - GRAM + 1])
            order = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            smallest = _sliding(np.minimum, order, span)
            over = (at[1:-1, None] - np.arange(1, least)).ravel()
            smallest[over[(over >= 0) & (over < len(smallest))]] = 0  # strings that would reach into the next text
            none = np.zeros(span - 1, np.uint32)
            p = np.flatnonzero(_sliding(np.maximum, np.concatenate([none, smallest, none]), span) == order)
            piece = np.searchsorted(at, p, "right") - 1
            self.key, self.row, self.place = h[p], row[piece], p - at[piece] + base[piece]
            self.lo, self.hi = np.maximum(p - (least - GRAM), at[piece]), np.minimum(p + least, at[piece + 1])
            self.lead = p - self.lo
            # A string holds the anchor with this many bytes before it, or else with as many after it.
            arm = (least - GRAM + 1) // 2
            hashed = lambda a, b, salt: words._mixed((run[b] - run[a]) * down[a] + np.uint64(salt))
            self.arms = np.zeros((2, len(p)), np.uint64)
            for side, fits, a, b in ((0, self.lead >= arm, p - arm, p + GRAM), (1, self.hi - p >= GRAM + arm, p, p + GRAM + arm)):
                self.arms[side, fits] = hashed(a[fits], b[fits], side + 1) | np.uint64(1)
            self.snippet = words._mixed((run[self.hi] - run[self.lo]) * down[self.lo] + ((self.hi - self.lo) * 64 + self.lead).astype(np.uint64))

    def bytes_of(self, at: np.ndarray) -> pa.Array:
        lo, size = self.lo[at], (self.hi - self.lo)[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.data[np.repeat(lo - ends[:-1], size) + np.arange(ends[-1])]
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])


def anchors(column: pa.Array, least: int) -> Iterator[Anchors]:
    data, offsets = words.buffers(column)
    row, lo, hi = _pieces(offsets, least)
    size = np.cumsum(hi - lo)
    i = 0
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE, "right")))
        at = np.concatenate([[0], np.cumsum(hi[i:j] - lo[i:j])])
        yield Anchors(np.concatenate([data[a:b] for a, b in zip(lo[i:j], hi[i:j], strict=True)]), at, row[i:j], lo[i:j] - offsets[row[i:j]], least)
        i = j


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    """A key's slot in the upper half, and 32 other bits of it."""
    return (key >> np.uint64(64 - bits) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))


class Shared:
    """Which anchors may stand twice, and which are hot."""

    def __init__(self, bits: int, regions: np.ndarray, hot: np.ndarray) -> None:
        self.bits, self.regions, self.hot = bits, regions, hot

    def split(self, a: Anchors) -> tuple[np.ndarray, np.ndarray]:
        """Places among a's anchors of those that may stand twice: not hot, and hot."""
        may = np.flatnonzero(self._twice(a.arms[0]) | self._twice(a.arms[1]))
        hot = np.zeros(len(may), bool)
        if len(self.hot):
            slot = _slot(a.key[may], self.bits)
            hot = self.hot[np.minimum(np.searchsorted(self.hot, slot), len(self.hot) - 1)] == slot
        return may[~hot], may[hot]

    def _twice(self, key: np.ndarray) -> np.ndarray:
        slot = _slot(key, self.bits)
        held = key > 0
        for bit in _two_bits(slot & np.uint64(0xFFFFFFFF), self.bits):
            bit = ((slot >> np.uint64(32)) << np.uint64(FILTER - self.bits)) | bit
            held &= (self.regions[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return held


def _two_bits(mark: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a slot's region that stand for a mark."""
    width = np.uint64(FILTER - bits)
    return mark & np.uint64((1 << (FILTER - bits)) - 1), ((mark * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)) >> (np.uint64(32) - width)


def _shared(docs: DataFrame, least: int) -> Shared:
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    many = 2 * size // (least - GRAM + 2)
    bits = min(max(6, (3 * many // GROUP).bit_length()), 20)
    hot = max(HOT, many // HOT_SHARE)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_slot(k[k > 0], bits) for a in anchors(b.column("text"), least) for k in (a.key, *a.arms)]
            if not keys:
                continue
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            slots, first = np.unique(key >> np.uint64(32), return_index=True)
            ends = pa.py_buffer((np.append(first, len(key)) * 4).astype(np.int32))
            marks, times = ((x & np.uint64(0xFFFFFFFF)).astype(np.uint32) for x in (key, n.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), *[pa.Array.from_buffers(pa.binary(), len(slots), [None, ends, pa.py_buffer(x)]) for x in (marks, times)]], ["slot", "marks", "times"])

    def summed(table: pa.Table) -> pa.Table:
        slot = table.column("slot")[0].as_py()
        marks, times = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint32) for c in ("marks", "times"))
        mark, at = np.unique(marks, return_inverse=True)
        n = np.bincount(at, times)
        region = np.zeros(1 << (FILTER - bits - 3), np.uint8)
        for bit in _two_bits(mark[n >= 2].astype(np.uint64), bits):
            np.bitwise_or.at(region, (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
        often = mark[n > hot].astype(np.int64) + (slot << 32)
        return pa.table({"slot": pa.array([slot], pa.int32()), "region": pa.array([region.tobytes()], pa.binary()), "hot": pa.array([often.tolist()], pa.list_(pa.int64()))})

    regions, found = np.zeros(1 << (FILTER - 3), np.uint8), []
    width = 1 << (FILTER - bits - 3)
    with scratch.freeing(docs.sparkSession):
        rows = docs.select("text").mapInArrow(counted, "slot int, marks binary, times binary").groupBy("slot").applyInArrow(summed, "slot int, region binary, hot array<long>")
        for r in rows.toArrow().to_batches():  # 2^FILTER bits in all, and hot anchors
            for slot, region, hot in zip(r.column("slot").to_pylist(), r.column("region"), r.column("hot").to_pylist(), strict=True):
                regions[slot * width : (slot + 1) * width] = np.frombuffer(region.as_buffer(), np.uint8)
                found += hot
    return Shared(bits, regions, np.sort(np.array(found, np.uint64)))


FOUND = "anchor long, snippet long, doc_id long, tag long, place int, lead int, size int, bytes binary"


def _found(docs: DataFrame, shared, least: int, hot: bool) -> DataFrame:
    """Anchors that may stand twice, with what is around them: of hot ones, or of the rest. Equal surroundings of hot
    anchors in one batch have their bytes once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, tag = b.column("doc_id"), b.column("tag")
            for a in anchors(b.column("text"), least):
                at = shared.value.split(a)[hot]
                if not len(at):
                    continue
                text = a.bytes_of(at)
                if hot:
                    once = np.zeros(len(at), bool)
                    once[np.unique(a.snippet[at], return_index=True)[1]] = True
                    text = pa.compute.if_else(pa.array(once), text, pa.scalar(None, pa.binary()))
                row = pa.array(a.row[at])
                numbers = [pa.array(x.astype(np.int32)) for x in (a.place[at], a.lead[at], (a.hi - a.lo)[at])]
                yield pa.RecordBatch.from_arrays([pa.array(a.key[at].view(np.int64)), pa.array(a.snippet[at].view(np.int64)), doc.take(row), tag.take(row), *numbers, text], "anchor snippet doc_id tag place lead size bytes".split())

    return docs.mapInArrow(work, FOUND)


def _intervals(common: list[int], before: list[int], first: int, last: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals of a run of the suffix array, inner ones first, that have
    more than one left extension. before has one value for each left extension, and values of their own for beginnings."""
    several = -(1 << 60)
    stack: list[list[int]] = []  # length, first, left extension
    for i in range(first, last + 1):
        high = common[i] if i < last else -1  # with the next
        low, left = i, before[i]
        while stack and stack[-1][0] > high:
            length, low, own = stack.pop()
            left = own if own == left else several
            if left == several:
                yield length, low, i
        if high >= least:
            if stack and stack[-1][0] == high:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == left else several
            else:
                stack.append([high, low, left])


def maximal_repeats(data: np.ndarray, at: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, texts, places): each string of `least` bytes or more that stands at several places of the texts
    data[at[i]:at[i + 1]], and can be lengthened on neither side without losing any of them, with all its places. Only
    suffixes whose first `least` bytes stand elsewhere enter the array. Meant for short texts: a row as wide as the
    longest is kept of each suffix."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    n = len(data) - least + 1
    if n <= 0:
        return
    with np.errstate(over="ignore"):
        run, down = _runs(data)
        h = words._mixed((run[least:] - run[:-least]) * down[:n])
    start = np.flatnonzero(text[:n] == text[least - 1 :])
    _, at_h, times = np.unique(h[start], return_inverse=True, return_counts=True)
    start = start[times[at_h] > 1]
    if not len(start):
        return
    long = at[text[start] + 1] - start
    width = -(-int(long.max()) // 8) * 8
    block = np.concatenate([data, np.zeros(width, np.uint8)])[start[:, None] + np.arange(width)]
    block[np.arange(width) >= long[:, None]] = 0
    columns = block.view(">u8").astype(np.uint64)
    order = np.lexsort([long, *columns.T[::-1]])
    start, long, block = start[order], long[order], block[order]
    apart = block[1:] != block[:-1]
    common = np.minimum(np.where(apart.any(1), apart.argmax(1), width), np.minimum(long[1:], long[:-1]))
    whose = text[start]
    before = np.where(start == at[whose], -1 - np.arange(len(start)), data[start - 1])
    # Runs that share `least` bytes; where all have the same left extension, the run one byte to the left has it all.
    first = np.flatnonzero(np.concatenate([[True], common < least]))
    last = np.append(first[1:], len(start)) - 1
    diverse = (np.minimum.reduceat(before, first) != np.maximum.reduceat(before, first)) & (last > first)
    lcp, left = common.tolist(), before.tolist()
    for a, b in zip(first[diverse].tolist(), last[diverse].tolist(), strict=True):
        for length, i, j in _intervals(lcp, left, a, b, least):
            yield length, whose[i : j + 1], start[i : j + 1] - at[whose[i : j + 1]]


def _covered(data: np.ndarray, at: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end), merged by text: what maximal repeats cover outside their smallest document."""
    found = []
    for length, texts, places in maximal_repeats(data, at, least):
        of = doc[texts]
        later = of > of.min()
        if later.any():
            found.append((texts[later], places[later], places[later] + length))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    text, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    step = int(hi.max()) + 1
    lo, hi = lo + text * step, hi + text * step
    order = np.argsort(lo, kind="stable")
    text, lo, hi = text[order], lo[order], np.maximum.accumulate(hi[order])
    begins = np.concatenate([[True], lo[1:] > hi[:-1]])
    ends = np.append(np.flatnonzero(begins)[1:] - 1, len(lo) - 1)
    return text[begins], lo[begins] - text[begins] * step, hi[ends] - text[begins] * step


SPANS = "doc_id long, tag long, low int, high int"


def _compared(least: int):
    """Spans to remove of anchors that come in order of anchor, snippet and document."""

    def spans(t: pa.Table) -> pa.RecordBatch | None:
        anchor, snippet, doc, tag, place, lead, size = (t.column(c).to_numpy() for c in "anchor snippet doc_id tag place lead size".split())
        begin = place - lead
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (snippet[1:] != snippet[:-1])])
        kind, head = np.cumsum(new) - 1, np.flatnonzero(new)
        # What a smaller document has with the same surroundings goes whole.
        whole = np.flatnonzero(doc > doc[head][kind])
        out = [(doc[whole], tag[whole], begin[whole], (begin + size)[whole])]
        # Of the rest, one row stands for each kind; those of anchors with several kinds are compared.
        _, at_a, kinds = np.unique(anchor[head], return_inverse=True, return_counts=True)
        some = np.flatnonzero(kinds[at_a] > 1)
        if len(some):
            data, at = words.buffers(t.column("bytes").take(pa.array(head[some])).combine_chunks())
            text, lo, hi = _covered(data[at[0] : at[-1]], at - at[0], doc[head[some]], least)
            k = some[text]
            same = np.bincount(kind[doc == doc[head][kind]], minlength=len(head))[k]  # rows of the kind's smallest document
            row = np.repeat(head[k], same) + np.arange(same.sum()) - np.repeat(np.cumsum(same) - same, same)
            out.append((doc[row], tag[row], begin[row] + np.repeat(lo, same), begin[row] + np.repeat(hi, same)))
        doc, tag, lo, hi = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tag), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["doc_id", "tag", "low", "high"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) < ROWS:
                continue
            t = pa.Table.from_batches(held)
            # Up to where the last anchor begins, as more of it may follow.
            cut = int(np.searchsorted(t.column("anchor").to_numpy(), t.column("anchor")[-1].as_py()))
            if cut:
                yield spans(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held:
            yield spans(pa.Table.from_batches(held))

    return work


def _hot_spans(spark: SparkSession, found: DataFrame, least: int) -> DataFrame:
    """Spans to remove of hot anchors, without their rows ever meeting."""
    found = scratch.written(found, "hot")
    kinds = found.groupBy("anchor", "snippet").agg(F.min("doc_id").alias("first"), F.min("lead").alias("lead"), F.min("bytes").alias("bytes"))
    kinds = scratch.written(kinds, "kinds")
    each = kinds.where(F.length("bytes") >= least).select("anchor", "snippet", "first", F.explode(F.sequence(F.lit(0), F.least("lead", F.length("bytes") - least))).alias("s"), "bytes")
    each = scratch.written(each.select("anchor", "snippet", "first", "s", F.xxhash64(F.substring("bytes", F.col("s") + 1, F.lit(least))).alias("string")), "strings")
    smallest = each.groupBy("anchor", "string").agg(F.min("first").alias("smallest"))
    later = each.join(smallest, ["anchor", "string"]).where("first > smallest").groupBy("anchor", "snippet").agg(F.collect_set("s").alias("at"))  # 31 at most
    known = scratch.written(kinds.select("anchor", "snippet", "first").join(later, ["anchor", "snippet"], "left"), "known")
    rows = found.drop("bytes").join(known, ["anchor", "snippet"])
    begin = F.col("place") - F.col("lead")
    own = F.transform(F.coalesce("at", F.array().cast("array<int>")), lambda s: F.struct((begin + s).alias("low"), (begin + s + least).alias("high")))
    whole = F.array(F.struct(begin.alias("low"), (begin + F.col("size")).alias("high")))
    return rows.select("doc_id", "tag", F.inline(F.when(F.col("doc_id") > F.col("first"), whole).otherwise(own)))


def repeated_spans(docs: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, tag, low, high): byte ranges, which may overlap, of texts (doc_id, tag, text) that together cover what is
    in any string of `least` bytes that also starts in a document with a smaller id. Rows without id or text have none."""
    if least <= GRAM:
        raise ValueError(f"least must be more than {GRAM}")
    spark = docs.sparkSession
    scratch.small_batches(spark)
    docs = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= least)).select("doc_id", "tag", "text")
    shared = _shared(docs, least)
    sent = spark.sparkContext.broadcast(shared)  # 2^FILTER bits and the list of hot anchors
    with scratch.freeing(spark):
        cold = _found(docs, sent, least, hot=False).repartition("anchor").sortWithinPartitions("anchor", "snippet", "doc_id")
        spans = scratch.written(cold.mapInArrow(_compared(least), SPANS), "spans")
        if len(shared.hot):
            spans = spans.unionByName(scratch.written(_hot_spans(spark, _found(docs, sent, least, hot=True), least), "spans"))
    sent.unpersist()
    return spans


def _cut(kept: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for text, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                left, end, removed, n = [], 0, 0, 0
                for low, high in sorted((x >> 32, x & 0xFFFFFFFF) for x in spans or []):
                    if low > end or not n:
                        left.append(data[end:low])
                        n += 1
                    removed += max(0, high - max(low, end))
                    end = max(end, high)
                rest = b"".join([*left, data[end:]])
                rows.append((len(data), removed, n, rest if kept else hashlib.sha256(rest).hexdigest()))
            size, removed, n, last = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, pa.int64()) for x in (size, removed, n)], pa.array(last, pa.binary() if kept else pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if kept else "kept_sha256"])

    return work


def remove_repeats(docs: DataFrame, least: int = 50, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): a row for each of docs (doc_id, text), with the bytes that are left
    once each byte is gone that any string of `least` bytes covers which also starts in a document with a smaller id;
    with `digest`, kept_sha256 in place of kept. Texts are UTF-8, strings are judged on the texts as they came, and what
    is cut may part a character's bytes.

    A null text counts as empty. A null id is neither smaller nor larger than any: such a text stays whole and removes
    nothing. Of rows with one id none is smaller, so they remove nothing from each other. Tables may be empty, and other
    columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Rows that share an id are told apart by their texts; equal ones have equal spans.
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").head() is not None
    docs = docs.withColumn("tag", F.xxhash64("text") if again else F.lit(0).cast("long"))
    spans = repeated_spans(docs, least)
    packed = (F.shiftleft(F.col("low").cast("long"), 32) + F.col("high")).alias("x")
    spans = spans.select("doc_id", "tag", packed).groupBy("doc_id", "tag").agg(F.collect_list("x").alias("spans"))  # by document
    kind = "kept_sha256 string" if digest else "kept binary"
    return docs.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans").mapInArrow(_cut(not digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, {kind}")


SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
m AS MATERIALIZED (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1),
c AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM w JOIN m USING (s) WHERE doc_id > first),
g AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c),
runs AS (SELECT r, min(i) AS low, max(i) + 50 AS high FROM g GROUP BY r, run),
gaps AS (SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS after FROM runs),
cut AS (SELECT r, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans, max(high) AS stop, string_agg(substr(h, 2 * after + 1, 2 * (low - after)), '' ORDER BY low) AS kept FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * stop + 1), h))) AS kept_sha256 FROM d LEFT JOIN cut USING (r)
"""
