"""Mixing sources to target weights by pivotal dependent rounding. DataFrame and SQL functions only.

Every document of a source is to be taken target / size of source times: a whole number of copies and a fraction.
Fractions are rounded in pairs: words move from one document's fraction to the other's, in a random direction with odds
that keep each document's expectation, until one of the two is a whole copy or none. The pair's words do not change, so
a source misses its target by less than one document. Pairs form inside small buckets; each bucket leaves at most one
fraction, and buckets' leftovers meet in a tree of buckets until one is left for each source, which chance rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Documents in a bucket, about, and buckets below one of the tree.
FAN = 32
WEIGHTS = (5, 2, 1)
#: Sources are broadcast up to this many (some 60 bytes each), else joined by shuffle.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, sr, source_size, n, target) from rows (source, size).

    Sources by code point, null last, get the weights in turn and share the total size by weight; a target above
    `most` times its source's size stops there, and the rest is shared again. That is one water level: the share of a
    unit of weight at which the capped and the open targets add up to the total.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("sr") - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("sr", rank).withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * most)
    level = F.col("cap") / F.col("w")
    upto, every = Window.orderBy("r"), Window.partitionBy()
    by = by.withColumn("r", level).withColumn("cap_upto", F.sum("cap").over(upto)).withColumn("w_upto", F.sum("w").over(upto))
    by = by.withColumn("all_w", F.sum("w").over(every)).withColumn("total", F.sum("source_size").over(every))
    by = by.withColumn("capped", F.col("cap_upto") + F.col("r") * (F.col("all_w") - F.col("w_upto")) <= F.col("total"))
    spent = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    open_w = F.sum(F.when(~F.col("capped"), F.col("w"))).over(every)
    by = by.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("total") - spent) / open_w * F.col("w")))
    return by.select("source", "sr", "source_size", "n", "target")


#: One step: acc holds the fraction left so far, x the next; of the two, one comes out whole.
_STEP = """
aggregate(xs, named_struct('left', cast(null as struct<k:bigint,p:double,doc_id:bigint,size:bigint>), 'done', cast(array() as array<struct<doc_id:bigint,size:bigint,one:int>>)),
  (acc, x) -> if(acc.left is null, named_struct('left', x, 'done', acc.done),
    transform(array(named_struct(
        'more', least(acc.left.size * (1 - acc.left.p), x.size * x.p),
        'less', least(acc.left.size * acc.left.p, x.size * (1 - x.p)))),
      m -> transform(array(pmod(xxhash64({seed}, acc.left.k, x.k), 9007199254740992) / 9007199254740992 * (m.more + m.less) < m.less), up ->
        transform(array(if(up,
            named_struct('a', if(acc.left.size * (1 - acc.left.p) <= x.size * x.p, 1D, acc.left.p + m.more / acc.left.size),
                         'b', if(acc.left.size * (1 - acc.left.p) <= x.size * x.p, greatest(x.p - m.more / x.size, 0D), 0D)),
            named_struct('a', if(acc.left.size * acc.left.p <= x.size * (1 - x.p), 0D, acc.left.p - m.less / acc.left.size),
                         'b', if(acc.left.size * acc.left.p <= x.size * (1 - x.p), least(x.p + m.less / x.size, 1D), 1D)))),
          q -> if(q.a <= 0 or q.a >= 1,
            named_struct('left', named_struct('k', x.k, 'p', q.b, 'doc_id', x.doc_id, 'size', x.size),
                         'done', concat(acc.done, array(named_struct('doc_id', acc.left.doc_id, 'size', acc.left.size, 'one', cast(q.a as int))))),
            named_struct('left', named_struct('k', acc.left.k, 'p', q.a, 'doc_id', acc.left.doc_id, 'size', acc.left.size),
                         'done', concat(acc.done, array(named_struct('doc_id', x.doc_id, 'size', x.size, 'one', cast(q.b as int))))))
        )[0])[0])[0]))
"""


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 17) -> DataFrame:
    """Per row of docs (doc_id long, text string, source string): doc_id, size, source_size, target, taken.

    size counts words (runs without ASCII white space; null and empty texts have 0 and nothing is taken of them), taken
    is a whole number of copies times size, at most `most` copies. Chance comes from hashes of doc_id and seed, so
    reruns agree. Repeated rows are rounded each on their own; null sources are one source; null doc_ids are kept. An
    empty table gives no rows; other columns are ignored. The number of sources is taken to be small enough to sort.
    """
    size = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.when(F.col("text").isNull(), 0).otherwise(size).cast("long").alias("size"))
    sized = written(sized, "sized")
    by = written(targets(sized, weights, most), "targets")
    n, largest = by.agg(F.count("*"), F.max("n")).first()
    few = F.broadcast(by) if n <= BROADCAST_SOURCES else by
    rows = sized.join(few, sized.source.eqNullSafe(by.source)).select("doc_id", "size", "sr", by.n, F.least(F.col("target") / F.greatest("source_size", F.lit(1)), F.lit(float(most))).alias("c"))
    whole = rows.where("size = 0 or c = floor(c)").select("doc_id", "size", "sr", F.floor("c").alias("copies"))
    parts = rows.where("size > 0 and c <> floor(c)")
    # Repeated rows differ by a running number, and so spread over buckets.
    parts = parts.groupBy("doc_id", "size", "sr", "n", "c").agg(F.count("*").alias("m")).select("*", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("copy")).drop("m")
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "copy"), F.greatest(F.lit(1), F.ceil(F.col("n") / FAN)))
    left = parts.select("sr", bucket.alias("bucket"), F.xxhash64("doc_id", "size", "copy").alias("k"), (F.col("c") - F.floor("c")).alias("p"), "doc_id", "size")
    floors = by.select("sr", F.floor(F.least(F.col("target") / F.greatest("source_size", F.lit(1)), F.lit(float(most)))).alias("low"))
    decided = None
    levels = 1 + max(0, math.ceil(math.log(max(1, (largest or 0) / FAN), FAN)))
    for level in range(levels + 1):
        met = left.groupBy("sr", "bucket").agg(F.array_sort(F.collect_list(F.struct("k", "p", "doc_id", "size"))).alias("xs"))
        met = written(met.select("sr", "bucket", F.expr(_STEP.format(seed=seed + level)).alias("r")), "rounded")
        done = met.select("sr", F.inline("r.done"))
        decided = done if decided is None else decided.unionByName(done)
        # A fraction that came out whole is decided; the next level leaves it as it is.
        left = met.where("r.left is not null").select("sr", F.expr(f"bucket div {FAN}").alias("bucket"), "r.left.*")
    last = F.pmod(F.xxhash64(F.lit(seed + 101), "k"), F.lit(1 << 53)) / (1 << 53) < F.col("p")
    decided = decided.unionByName(left.select("sr", "doc_id", "size", last.cast("int").alias("one")))
    taken = decided.join(F.broadcast(floors) if n <= BROADCAST_SOURCES else floors, "sr").select("doc_id", "size", "sr", (F.col("low") + F.col("one")).alias("copies")).unionByName(whole)
    out = taken.join(few.drop("n"), "sr")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
