"""Importance resampling towards a target: documents whose hashed n-grams look like the target's are drawn more often.

Each partition has a DuckDB of its own, which takes texts apart by SQL: words are unnested, n-grams read off a window,
and hashed by zlib's CRC-32, registered as a vectorised function. A document leaves it as the counts of its buckets,
which Spark keeps as Parquet in the shared folder; merging them, gains, scores and ranks are DataFrame work. What meets
in one place is a count for each bucket and for each score, never a document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlens.operators import scan

from . import scratch

#: Bytes of text that a query takes at once; one text longer than that goes alone.
SLICE = 4 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COUNTS = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>"


def _crc(words: pa.ChunkedArray) -> pa.Array:
    return pa.array(np.fromiter((zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()), np.uint32, len(words)))


def _features(n: int) -> str:
    """SQL for (r, f) over words (r, p, w): all runs of 1 to n consecutive words, read off a window."""
    if n == 1:
        return "SELECT r, w AS f FROM words"
    ahead = [f"lead(w, {i}) OVER o" for i in range(1, n)]
    runs = ", ".join(["w"] + [" || ' ' || ".join(["w", *ahead[:i]]) for i in range(1, n)])
    return f"SELECT r, f FROM (SELECT r, unnest([{runs}]) AS f FROM words WINDOW o AS (PARTITION BY r ORDER BY p)) WHERE f IS NOT NULL"


def _query(n: int, buckets: int) -> str:
    """Distinct features are hashed once, however often they occur in a slice."""
    return f"""WITH lists AS MATERIALIZED (SELECT r, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS x FROM slice),
words AS (SELECT r, unnest(x) AS w, generate_subscripts(x, 1) AS p FROM lists),
each AS MATERIALIZED (SELECT r, f, count(*) AS n FROM ({_features(n)}) GROUP BY r, f),
hashed AS (SELECT f, (crc(f) % {buckets})::INT AS b FROM (SELECT DISTINCT f FROM each)),
held AS (SELECT r, b, sum(n)::BIGINT AS n FROM each JOIN hashed USING (f) GROUP BY r, b),
docs AS (SELECT r, sum(n)::BIGINT AS n, list(b) AS bs, list(n) AS ns FROM held GROUP BY r)
SELECT len(x)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(bs, []::INT[]) AS buckets, coalesce(ns, []::BIGINT[]) AS counts FROM lists LEFT JOIN docs USING (r) ORDER BY r"""


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum([0] + [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("text")])
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + SLICE, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """COUNTS of each row of texts (doc_id, text): its words, its features, and the features in each of its buckets."""
    query = _query(n, buckets)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        con.create_function("crc", _crc, ["VARCHAR"], "UINTEGER", type="arrow")
        for batch in batches:
            for part in _slices(batch):
                con.register("slice", pa.table({"r": pa.array(range(len(part)), pa.int64()), "text": part.column("text").fill_null("")}))
                found = con.sql(query).to_arrow_table().combine_chunks()
                con.unregister("slice")
                for held in found.to_batches():
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *held.columns], ["doc_id", *held.schema.names])
        con.close()

    return texts.mapInArrow(work, COUNTS)


def _merged(counts: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket, over all rows."""
    flat = counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy("x.buckets").agg(F.sum("x.counts").alias("n"))
    total = [0] * buckets
    for r in flat.collect():  # a row for each bucket at most
        total[r.buckets] = r.n
    return total


def _numbers(values: list[int]):
    """A constant array, by the position of its values."""
    return F.from_json(F.lit(str(values)), "array<bigint>")


def _gains(spark, have: list[int], want: list[int]) -> list[int]:
    """floor(1000 ln(((t + 1)(S + m)) / ((s + 1)(T + m)))) of each of m buckets, in doubles."""
    m = len(have)
    rows = spark.createDataFrame([(i, float(s), float(t)) for i, (s, t) in enumerate(zip(have, want, strict=True))], "i int, s double, t double")
    ratio = ((F.col("t") + 1) * float(sum(have) + m)) / ((F.col("s") + 1) * float(sum(want) + m))
    return [r.g for r in rows.select("i", F.floor(1000 * F.ln(ratio)).alias("g")).orderBy("i").collect()]


def _least(eligible: DataFrame, draw: int) -> int | None:
    """The smallest score that any of the `draw` rows with the highest scores has. Rows of each score are counted: scores
    are whole numbers within some tens of thousands, whatever the corpus."""
    sizes = sorted(((r.score, r.n) for r in eligible.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    for score, n in sizes:
        draw -= n
        if draw <= 0:
            return score
    return sizes[-1][0] if sizes else None


def importance_resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): a row for each of docs (doc_id, text), drawn towards target (text).

    Features are runs of 1 to n words; a bucket gains by how much more of the target falls in it than of docs (add-one),
    in thousandths of e-folds; weight is the floored mean gain of a document's features (none: 0), and score adds Gumbel
    noise taken from the id, so that the highest scores are a draw without replacement. Of the N rows with at least
    `least` words, percent * N / 100 (floored) are drawn: rank is 1, 2, 3... by score, ties to the smaller id (then fewer
    features), and null for all others.

    A null text has no features; a null id counts as an empty one for the noise and comes last. Repeated rows count and
    are drawn each on its own. Empty tables are allowed on either side, and other columns are not read.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    counts = scratch.written(bucket_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, buckets), "buckets")
    wanted = bucket_counts(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), n, buckets)
    gains = _numbers(_gains(spark, _merged(counts, buckets), _merged(wanted, buckets)))
    total = F.aggregate(F.arrays_zip("buckets", "counts"), F.lit(0).cast("long"), lambda s, x: s + F.get(gains, x["buckets"]) * x["counts"])
    mean = F.when(F.col("n_features") > 0, (total - F.pmod(total, F.col("n_features"))) / F.col("n_features")).otherwise(0)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = counts.select("doc_id", "n_features", F.round(mean).cast("long").alias("weight"), noise.alias("noise"), (F.col("n_words") >= least).alias("eligible"))
    scored = scratch.written(scored.select("doc_id", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"), "eligible"), "scores")
    draw = percent * scored.where("eligible").count() // 100
    bound = _least(scored.where("eligible"), draw)
    key = ["doc_id", "n_features", "weight", "score"]
    if not draw:
        return scored.select(*key, F.lit(None).cast("long").alias("rank"))
    may = F.col("eligible") & (F.col("score") >= bound)
    top = scored.where(may).withColumns({"_first": -F.col("score"), "_last": F.col("doc_id").isNull()})
    ranked = scan.numbered(top, ["_first", "_last", "doc_id", "n_features"], "rank").select(*key, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~may).select(*key, F.lit(None).cast("long").alias("rank")))


#: CRC-32 by a table of 256 remainders, over the bytes of each distinct word; else as the operator has it.
SQL = r"""
WITH RECURSIVE bits AS (SELECT i, i AS v, 0 AS step FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, step + 1 FROM bits WHERE step < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE step = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS x FROM documents),
g AS MATERIALIZED (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS x FROM benchmark),
dw AS (SELECT r, unnest(x) AS w FROM d), gw AS (SELECT unnest(x) AS w FROM g),
words AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM gw)),
crc AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % 10000 AS b FROM words, tab),
s AS (SELECT b, count(*) AS s FROM dw JOIN crc USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM gw JOIN crc USING (w) GROUP BY b),
gain AS MATERIALIZED (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS g
  FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
mean AS (SELECT r, count(*) AS n, sum(g)::BIGINT AS total FROM dw JOIN crc USING (w) JOIN gain USING (b) GROUP BY r),
weighed AS (SELECT d.r, doc_id, len(x) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN mean USING (r)),
scored AS MATERIALIZED (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""
