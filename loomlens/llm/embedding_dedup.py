"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank.

A sample teaches rotations under which the signs of centred vectors are balanced bits that keep most of what the vectors
say: in turn, codes are read off the rotated sample, and the rotation is fitted to the codes. Substrings of the codes
are the keys of tables. Each code stands in every table under its own key and, where the plan probes, under the keys that
have one bit more; codes that meet in a table are compared by Hamming distance. Only the vectors of codes within the
radius are fetched, and measured by cosine.

Longer keys make smaller buckets and take more tables, and so more rotations, each learned from a start of its own;
probes take fewer tables and more rows. Keys, tables, probes and radius are read off pairs planted at the threshold
among vectors that the rotations were not learned from, at every size alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import written

#: Rotations are learned, and keys chosen, by at most so many vectors of a width, PAIRED of them against each other; every
#: vector is indexed.
SAMPLE, PAIRED = 4_000, 1000
#: Steps of learning, and pairs planted at the threshold to choose by.
ROUNDS, PLANTED = 20, 2000
#: The least chance that a pair at the threshold is compared.
RECALL = 0.9998
#: A code's row in a table costs about as much as comparing it with so many others, and as much again for so many bits.
COPY, CARRIED = 4000, 512
#: Most codes of one bucket that a task compares at once; larger buckets are dealt as pairs of blocks.
BLOCK = 1024
#: Small buckets are compared together, up to so many codes at once.
TOGETHER = 192
#: Codes have at least so many bits, so that short keys too come with a distance that tells vectors apart.
LEAST_BITS = 128


class Plan(NamedTuple):
    """Codes of one width: the keys' bits, how many tables, how many bits a probed key may differ in (0 or 1), the Hamming
    distance of codes to compare, the mean of the sample, and the learned normals as columns. The first bits * tables
    of a code are the keys."""

    bits: int
    tables: int
    probes: int
    radius: int
    mean: np.ndarray
    normals: np.ndarray


def learn_rotation(x: np.ndarray, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """A rotation of centred vectors x, from a random start, that brings them close to their own signs."""
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        codes = np.where(x @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ x)
        rotation = (left @ right).T
    return rotation


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _at_threshold(x: np.ndarray, threshold: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at the threshold: from vectors of the sample, half of them in any direction, half in the
    direction of another vector."""
    a = x[rng.integers(0, len(x), PLANTED)]
    off = np.where((np.arange(PLANTED) % 2 == 0)[:, None], rng.standard_normal(a.shape), x[rng.integers(0, len(x), PLANTED)] + 1e-3 * rng.standard_normal(a.shape))
    off -= (off * a).sum(1, keepdims=True) * a
    length = np.linalg.norm(off, axis=1, keepdims=True)
    off = np.divide(off, length, out=np.zeros_like(off), where=length > 1e-12)
    t = min(1.0, max(-1.0, threshold))
    return a, t * a + math.sqrt(1 - t * t) * off


def _sides(x: np.ndarray, plan: Plan) -> np.ndarray:
    """The code of each vector, (vectors, bits)."""
    return (x - plan.mean) @ plan.normals >= 0


def _keys(sides: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The key of each code in each table, (codes, tables)."""
    keyed = sides[:, : bits * tables].reshape(len(sides), tables, bits)
    return (keyed.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(2, dtype=np.uint64)


def plan_tables(x: np.ndarray, label: np.ndarray, others: float, threshold: float, longest: int = 64, block: int = BLOCK, recall: float = RECALL, probing: tuple[int, ...] = (0, 1), seed: int = 7) -> Plan:
    """Codes for unit vectors x, a sample that stands for labels of `others` vectors on average.

    A quarter of the sample is held out of what rotations are learned from, and pairs at the threshold are planted
    there. For keys of each length, with probes and without, the tables are those that let planted pairs meet in one
    with a chance of `recall`, by how often their bits agree; of these the cheapest is taken, by how often other pairs'
    bits agree. It is then tried on the planted pairs, and gets more tables, or shorter keys, until it meets them. The
    radius is the largest distance of a planted pair and a standard deviation more. Keys of no bits make one table
    that compares all codes, so there always is an answer.
    """
    rng = np.random.default_rng([seed, x.shape[1]])
    width, apart = x.shape[1], np.arange(len(x)) % 4 == 3
    taught, held = (x, x) if len(x) < 64 else (x[~apart], x[apart])
    mean = taught.mean(0)
    a, b = _at_threshold(held, threshold, rng)
    learned: list[np.ndarray] = []

    def normals(n: int) -> np.ndarray:
        while len(learned) * width < n:
            learned.append(learn_rotation(taught - mean, rng))
        return np.concatenate(learned, 1)[:, :n]

    few = normals(max(256, width))
    side = lambda v: (v - mean) @ few >= 0
    agree = (side(a) == side(b)).mean(1)
    near = x[:PAIRED]
    signs = np.where(side(near), 1.0, -1.0)
    same = np.triu(label[:PAIRED, None] == label[None, :PAIRED], 1)
    if not same.any():
        same = np.triu(np.ones_like(same), 1)
    alike = ((signs @ signs.T / signs.shape[1] + 1) / 2)[same]
    choices = [(others > block / 2, COPY * (1 + (1 + others) / block) + (1 + others) / 2, 0, 1, 0)]
    for k in range(1, longest + 1):
        for probes in probing:
            if probes and k < 8:  # a short key with its neighbours says next to nothing
                continue
            hit, met = ((z**k + probes * k * z ** (k - 1) * (1 - z)) for z in (agree, alike))
            tables = next((t for t in _counts(4096) if (1 - (1 - hit) ** t).mean() >= recall), 0)
            if not tables:
                continue
            rows = 1 + probes * k / 2
            bucket = rows * (1 + others * ((alike**k).mean() if len(alike) else 0.5**k))
            compared = 1 + others * (met.mean() if len(met) else rows * 0.5**k)
            # Buckets of a few blocks first: larger ones are dealt as pairs of blocks, rows that grow with their square.
            choices.append((bucket > 4 * block, tables * (rows * COPY * (1 + k * tables / CARRIED) * (1 + bucket / block) + compared / 2), k, tables, probes))
    bits, tables, probes = min(choices)[2:]
    while True:
        plan = Plan(bits, tables, probes, 0, mean, normals(max(LEAST_BITS, bits * tables)))
        one, other = _sides(a, plan), _sides(b, plan)
        meet = np.bitwise_count(_keys(one, bits, tables) ^ _keys(other, bits, tables)) <= probes
        if meet.any(1).mean() >= recall - 1 / PLANTED:
            distance = (one != other).sum(1)
            return plan._replace(radius=int(math.ceil(distance.max() + distance.std())))
        tables += max(1, tables // 4)
        if tables > 4096:
            bits, tables = bits - 1, 1


def _counts(most: int) -> Iterator[int]:
    n = 1
    while n <= most:
        yield n
        n += max(1, n // 16)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def _coded(rows: Iterator[pa.RecordBatch], plans, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of each code in each table: at home under its key, and as a guest under the keys that have one bit more, if
    the plan probes. Codes that differ in one bit of a key meet once, where the one with that bit is at home."""
    for batch in rows:
        widths = np.asarray(batch.column("width"))
        for width in np.unique(widths).tolist():
            plan, part = plans.value[width], batch.filter(pa.array(widths == width))
            sides = _sides(_unit(_matrix(part.column("v"), width)), plan)
            keys = _keys(sides, plan.bits, plan.tables)
            code = pa.array([c.tobytes() for c in np.packbits(sides, 1)], pa.binary())
            same = [*(part.column(c) for c in ("rep", "label", "width")), code]
            for t in range(plan.tables):
                for more in [None, *range(plan.bits)] if plan.probes else [None]:
                    fit, key = np.ones(len(part), bool), keys[:, t]
                    if more is not None:
                        bit = np.uint64(1) << np.uint64(more)
                        fit, key = (key & bit) == 0, key | bit
                    out = [*same, pa.array(np.full(len(part), t, np.int32)), pa.array(key.view(np.int64)), pa.array(np.full(len(part), more is None))]
                    yield pa.RecordBatch.from_arrays(out, schema=schema).filter(pa.array(fit))


#: What makes a bucket, or a pair of blocks of one.
BUCKET = ("width", "label", "t", "key", "i", "j")


def _starts(t: pa.RecordBatch) -> np.ndarray:
    """Which rows have another bucket than the row before."""
    keys = np.stack([np.asarray(t.column(c)).astype(np.int64) for c in BUCKET], 1)
    return np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])


def _close(t: pa.RecordBatch, shapes: dict[int, tuple[int, int, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of codes in whole buckets of one width that share a bucket, lie within the radius, did not meet in
    an earlier table, and are not both guests; in parts. A pair is found in one bucket and one pair of blocks only."""
    bits, tables, probes, radius = shapes[t.column("width")[0].as_py()]
    table, side, home = (np.asarray(t.column(c)) for c in ("t", "side", "home"))
    across = np.asarray(t.column("i")) != np.asarray(t.column("j"))
    n, bucket = len(t), np.cumsum(_starts(t))
    packed = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(n, -1)
    words = np.zeros((n, -(-packed.shape[1] // 8) * 8), np.uint8)
    words[:, : packed.shape[1]] = packed
    words = words.view(np.uint64)
    for a in range(0, n, 256):
        b = slice(a, min(a + 256, n))
        distance = np.zeros((b.stop - a, n - a), np.uint16)
        for w in range(words.shape[1]):
            distance += np.bitwise_count(words[b, None, w] ^ words[None, a:, w])
        near = (distance <= radius) & (np.arange(a, n)[None, :] > np.arange(a, b.stop)[:, None]) & (bucket[b, None] == bucket[None, a:])
        near &= (home[b, None] | home[None, a:]) & (~across[b, None] | (side[b, None] != side[None, a:]))
        i, j = np.nonzero(near)
        i, j = i + a, j + a
        for k in range(0, len(i), 16384):
            p, q = i[k : k + 16384], j[k : k + 16384]
            apart = np.unpackbits(packed[p] ^ packed[q], 1, bits * tables).reshape(len(p), tables, bits).sum(2, dtype=np.uint8)
            new = ~((apart <= probes) & (np.arange(tables) < table[p, None])).any(1)
            yield p[new], q[new]


def _buckets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in whole buckets: a large one by itself, small ones of a width together."""
    held: list[pa.RecordBatch] = []  # whole buckets
    open_: list[pa.RecordBatch] = []  # the last bucket, which the next rows may go on with
    now = None
    size = lambda parts: sum(map(len, parts))

    def joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if size(parts) > 1:
            yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in rows:
        if not len(batch):
            continue
        cuts = [*np.flatnonzero(_starts(batch)).tolist(), len(batch)]
        names = list(zip(*(np.asarray(batch.column(c))[cuts[:-1]].tolist() for c in BUCKET), strict=True))
        for key, lo, hi in zip(names, cuts[:-1], cuts[1:], strict=True):
            if key != now:
                if held and (size(held) + size(open_) > TOGETHER or held[0].column("width")[0].as_py() != now[0]):
                    yield from joined(held)
                    held = []
                held, open_, now = held + (open_ if size(open_) > 1 else []), [], key
            open_.append(batch.slice(lo, hi - lo))
    if held and (size(held) + size(open_) > TOGETHER or held[0].column("width")[0].as_py() != now[0]):
        yield from joined(held)
        held = []
    yield from joined(held + (open_ if size(open_) > 1 else []))


def _within(rows: Iterator[pa.RecordBatch], shapes: dict[int, tuple[int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket that have another within the radius. At most two blocks are held at a time."""
    for t in _buckets(rows):
        hit = np.zeros(len(t), bool)
        for i, j in _close(t, shapes):
            hit[i] = hit[j] = True
        if hit.any():
            yield t.filter(pa.array(hit))


def _reranked(rows: Iterator[pa.RecordBatch], threshold: float, shapes: dict[int, tuple[int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """For each bucket, or pair of blocks of one: how many vectors each vector links with, and edges that span its links.
    Rows are sorted by bucket; one bucket's rows, at most two blocks, are held at a time."""
    for t in _buckets(rows):
        n = len(t)
        x = _unit(_matrix(t.column("v"), t.column("width")[0].as_py()))
        rep, copies = (np.asarray(t.column(c)) for c in ("rep", "copies"))
        count, edges = np.zeros(n, np.int64), ([], [])
        root = np.arange(n)

        def find(i: int, root=root) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in _close(t, shapes):
            # One order of summing for every pair, so that the threshold means the same in every bucket.
            good = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 8192]], x[j[k : k + 8192]]) >= threshold for k in range(0, len(i), 8192)] or [np.zeros(0, bool)])
            i, j = i[good], j[good]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                u, v = find(p), find(q)
                if u != v:
                    root[u] = v
                    edges[0].append(rep[p])
                    edges[1].append(rep[q])
        hit = np.flatnonzero(count)
        if len(hit):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rep[hit], np.array(edges[0], np.int64)])), pa.array(np.concatenate([count[hit], np.zeros(len(edges[0]), np.int64)])), pa.array([None] * len(hit) + [int(e) for e in edges[1]], pa.int64())], ["rep", "n", "other"]
            )


def embedding_near_dedup(vectors: DataFrame, threshold: float = 0.98, longest: int = 64, sample: int = SAMPLE, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """Per row of vectors (vec_id long, embedding array<float> or array<double>, label int): vec_id, n_links,
    component_id, kept.

    Rows link when their labels are equal and their cosine, in double precision, is threshold or more. Equal vectors of
    one label are collapsed first and counted as often as they occur. Pairs are found by tables of keys of at most
    `longest` bits, compared by the Hamming distance of their codes, and measured on the original vectors. A pair at the threshold is met with a chance of about `recall`
    or more, at every size, a nearer one with more; the codes of small labels are compared whole. No pair below the threshold is
    linked. Vectors of several widths are searched each among their own; widths are taken to be few, as each has its
    rotations learned on the driver from at most `sample` vectors.

    Null vectors, empty ones, vectors of zeros or with null or non-finite components, and null labels link with
    nothing: n_links 0, own component. Rows that repeat a vec_id count each; a null vec_id is returned with n_links of
    its vector and the component's smallest id. Empty tables give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    # Components stay as they are stored: floats as floats, anything else as doubles.
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"), F.col("label").cast("long").alias("label"))
    sound = "v is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    usable = src.where(sound)
    # Numbered once and written: every vector of a label has a number that no other has.
    classes = usable.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = written(classes.select("*", F.size("v").alias("width"), F.monotonically_increasing_id().alias("rep")), "classes")
    sizes = classes.groupBy("width", "label").agg(F.count("*").cast("double").alias("m")).groupBy("width").agg((F.sum(F.col("m") * F.col("m")) / F.sum("m")).alias("others"))
    plans = {}
    for width, others in sizes.collect():  # widths are few
        # A bounded sample, the same whatever the partitioning: the smallest hashes.
        few = classes.where(F.col("width") == width).select("v", "label").orderBy(F.xxhash64("label", "v"), "label", "v").limit(sample).toPandas()
        plans[width] = plan_tables(_unit(np.stack(few["v"].to_list()).astype(np.float64)), few["label"].to_numpy(), others, threshold, longest, block, recall)
    if not plans:
        return src.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    shared = spark.sparkContext.broadcast(plans)  # width * max(bits * tables, LEAST_BITS) doubles for each width
    arrow = pa.schema([("rep", pa.int64()), ("label", pa.int64()), ("width", pa.int32()), ("code", pa.binary()), ("t", pa.int32()), ("key", pa.int64()), ("home", pa.bool_())])
    coded = written(classes.select("rep", "label", "width", "v").mapInArrow(partial(_coded, plans=shared, schema=arrow), "rep long, label long, width int, code binary, t int, key long, home boolean"), "codes")
    key = ["width", "label", "t", "key"]
    full = coded.groupBy(*key).agg(F.count("*").alias("n"), F.max("home").alias("owned")).where("n > 1 and owned")
    full = full.select(*key, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = coded.join(full, key).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("mine", "with"), "j": F.greatest("mine", "with"), "side": F.col("mine")}).drop("mine", "with", "blocks")
    order = [*key, "i", "j"]
    dealt = dealt.select("rep", *order, "side", "home", "code")
    shapes = {w: (p.bits, p.tables, p.probes, p.radius) for w, p in plans.items()}
    sorted_ = lambda rows: rows.repartition(*order).sortWithinPartitions(*order, "rep")
    within = written(sorted_(dealt).mapInArrow(partial(_within, shapes=shapes), dealt.schema), "within")
    # Vectors travel only to the buckets where their code has another within the radius.
    fetched = within.join(classes.select("rep", "copies", "v"), "rep")
    met = sorted_(fetched).mapInArrow(partial(_reranked, threshold=threshold, shapes=shapes), "rep long, n long, other long")
    met = written(met, "met")
    counted = met.where("other is null").groupBy("rep").agg(F.sum("n").alias("n"))
    grouped = components(met.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    grouped = grouped.withColumnRenamed("node", "rep").join(classes.select("rep", "least"), "rep")
    low = grouped.groupBy("component").agg(F.min("least").alias("low"))
    grouped = grouped.join(low, "component").select("rep", "low")
    known = classes.join(counted, "rep", "left").join(grouped, "rep", "left")
    known = known.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "least").alias("component_id"))
    out = usable.join(known, ["label", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return out.unionByName(src.where(f"not coalesce({sound}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
