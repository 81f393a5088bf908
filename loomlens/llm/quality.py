"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .scratch import small_batches

#: Weights of the model.
DIMENSIONS = 1 << 18
#: At most so many labelled documents are fitted on.
SAMPLE = 6_000
VALUE = words.table(words.WHITE, fold=False)[1]
_CLASS = np.zeros(256, np.uint8)
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2
_CLASS[[c for c in range(256) if c >= 128 or chr(c).isalnum()]] = 1
_BLANK = _CLASS == 0


def _features(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text, the distinct hashed n-grams and their values, of unit length.

    Words are runs of letters and digits, and runs of ASCII punctuation; n-grams are words, pairs of words, and how a
    word's form (its first byte's class and case) and length follow the word before or repeat it.
    """
    data, offsets = words.buffers(batch.column("text"))
    for i, j in words.slices(offsets):
        lo = offsets[i]
        d, at0 = data[lo : offsets[j]], offsets[i : j + 1] - lo
        kind = _CLASS[d]
        # A change between letters and punctuation parts words as white space does.
        cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
        points = np.union1d(at0, cut)
        s, e, _ = words.spans(d, points, _BLANK)
        at = np.searchsorted(s, at0)
        if not len(s):
            for _ in range(i, j):
                yield np.zeros(0, np.int64), np.zeros(0)
            continue
        h, _ = words.hashed(d, points, (_BLANK, VALUE))
        upper = (d[s] >= 65) & (d[s] <= 90) & (d[np.minimum(s + 1, e - 1)] >= 65) & (d[np.minimum(s + 1, e - 1)] <= 90)
        form = kind[s].astype(np.uint64) * np.uint64(2) + upper
        pair = words.grams(h, 2)
        same = (h[1:] == h[:-1]).astype(np.uint64)
        forms = words.grams(form + np.uint64(11), 2) + same
        one, two, three = ((x >> np.uint64(40)).astype(np.int64) % DIMENSIONS for x in (h, pair, words._mixed(forms)))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            index, n = np.unique(np.concatenate([one[a:b], two[a : max(a, b - 1)], three[a : max(a, b - 1)]]), return_counts=True)
            x = np.log1p(n)
            yield index, x / (np.sqrt((x * x).sum()) or 1)


def _fitted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights, from all examples of the one partition that holds the sample."""
    examples = [(y, index.astype(np.int32), x.astype(np.float32)) for batch in rows for y, (index, x) in zip(batch.column("y").to_pylist(), _features(batch), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([fit(examples).tobytes()], pa.binary())], ["weights"])


def fit(examples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4) -> np.ndarray:
    """Weights (the last is the intercept) by per-coordinate FTRL-proximal updates, in the order of the examples."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for y, index, x in examples:
            i, v = np.append(index, DIMENSIONS), np.append(x, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(slice(None))


def _scored(rows: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    w = model.value
    for batch in rows:
        score = [1 / (1 + np.exp(-np.clip(w[index] @ x + w[-1], -35, 35))) for index, x in _features(batch)]
        keep = [batch.column(c) for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(score, pa.float64())], [*(c for c in batch.schema.names if c != "text"), "score"])


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The model's weights, from labelled documents whose crc32(doc_id as text) mod 3 is not 1.

    At most `sample` of them, the ones with the smallest hashes of doc_id and text, so the fit is the same whatever
    the partitioning. Null ids and labels are not used; a document with several labels is used once for each; without
    examples all weights are 0 and all scores 0.5.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).distinct()
    # Whole texts are fetched for the drawn ids only.
    present = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    drawn = known.join(present, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = text.join(F.broadcast(drawn), "doc_id").select("y", "text", F.xxhash64("doc_id", "text").alias("o")).orderBy("o", "y").limit(sample).drop("o")  # sample bounds both
    found = rows.coalesce(1).mapInArrow(_fitted, "weights binary").first()
    return np.frombuffer(found[0], np.float64) if found else np.zeros(DIMENSIONS + 1)


def quality_score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs without text, plus score (0 to 1: how likely label 1 is). A text's words alone decide; empty and null
    texts score as the intercept does. Every other column of docs is kept as it is."""
    small_batches(docs.sparkSession)
    if "score" in docs.columns:
        docs = docs.drop("score")
    model = docs.sparkSession.sparkContext.broadcast(weights)
    src = docs.withColumn("text", F.col("text").cast("binary"))
    schema = [f for f in src.schema.fields if f.name != "text"]
    return src.mapInArrow(partial(_scored, model=model), T.StructType([*schema, T.StructField("score", T.DoubleType())]))


def quality_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    held_out rows (crc32(doc_id as text) mod 3 is 1) are never learned from; a null doc_id is not held out, nor
    learned from. predicted is 1 where score >= 0.5.
    """
    scored = quality_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train_quality(docs, labels, sample))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _kept(rows: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    w = model.value
    for batch in rows:
        yield batch.filter(pa.array([bool(w[index] @ x + w[-1] >= 0) for index, x in _features(batch)], pa.bool_()))


def keep_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of docs that score 0.5 or more, with all their columns."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.mapInArrow(partial(_kept, model=model), docs.schema)
