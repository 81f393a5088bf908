"""Centroid clustering in integers, with Elkan's bounds kept beside each vector.

Every component becomes floor(scale * x), so that distances and means are exact and the result depends on nothing but the
rows. A vector carries an upper bound of the distance to its own centroid and a lower bound for each; when centroids
move, bounds move by as much, rounded away from the truth, and the triangle inequality rules most centroids out. A
centroid is skipped only if it is strictly farther than the own one, so ties are always compared and go to the smaller
number. Vectors with their bounds are a table in the shared folder, one a round; what a round sends to the driver is a
sum for each cluster and component, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Beyond this a squared distance of 64 components might not fit a long.
LARGEST = 1 << 27
STATE = "vec_id long, v array<int>, cluster int, upper double, lower array<double>"
#: Vectors whose distances are worked on at once.
BLOCK = 8192


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x, -np.inf), 0.0)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a centroid, or to a centroid each."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


class Bounds:
    """Centroids, how far each has moved since the bounds were made (rounded up), and half the distances between them
    (rounded down)."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None) -> None:
        self.centroids, self.first = now, before is None
        self.moved = np.zeros(len(now)) if before is None else np.where((now == before).all(1), 0.0, _up(np.sqrt(squared(now, before).astype(float))))
        self.half = np.stack([_down(_down(np.sqrt(squared(now, c).astype(float))) / 2) for c in now]) if len(now) else np.zeros((0, 0))

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings cluster, upper and lower (n x k) up to date in place; gives the number of distances calculated."""
        c, n = self.centroids, len(v)
        if self.first:
            own = squared(v, c[0])
            cluster[:], upper[:], lower[:] = 0, _up(np.sqrt(own.astype(float))), 0.0
            lower[:, 0] = _down(np.sqrt(own.astype(float)))
            known, done = np.ones(n, bool), n
        else:
            upper[:] = np.where(self.moved[cluster] > 0, _up(upper + self.moved[cluster]), upper)
            lower[:] = np.where(self.moved > 0, _down(lower - self.moved), lower)
            own, known, done = np.zeros(n, np.int64), np.zeros(n, bool), 0
        for j in range(len(c)):
            near = lambda at: (cluster[at] != j) & (upper[at] >= lower[at, j]) & (upper[at] >= self.half[cluster[at], j])
            rows = np.flatnonzero(near(slice(None)))
            stale = rows[~known[rows]]
            if len(stale):
                # The own distance is calculated once, and makes both its bounds tight.
                own[stale] = squared(v[stale], c[cluster[stale]])
                root = np.sqrt(own[stale].astype(float))
                upper[stale], lower[stale, cluster[stale]], known[stale] = _up(root), _down(root), True
                done += len(stale)
                rows = rows[near(rows)]
            d = squared(v[rows], c[j])
            done += len(rows)
            lower[rows, j] = _down(np.sqrt(d.astype(float)))
            better = (d < own[rows]) | ((d == own[rows]) & (j < cluster[rows]))
            rows, d = rows[better], d[better]
            cluster[rows], own[rows], upper[rows] = j, d, _up(np.sqrt(d.astype(float)))
        return done


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(x).ravel(), kind))


def _assigned(df: DataFrame, bounds: Bounds) -> DataFrame:
    k, width = bounds.centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), BLOCK):
                b = whole.slice(at, BLOCK)
                v = _rows(b.column("v"), width).astype(np.int64)
                if bounds.first:
                    cluster, upper, lower = np.zeros(len(b), np.int32), np.zeros(len(b)), np.zeros((len(b), k))
                else:
                    cluster, upper, lower = b.column("cluster").to_numpy().copy(), b.column("upper").to_numpy().copy(), _rows(b.column("lower"), k).copy()
                bounds.assign(v, cluster, upper, lower)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cluster, pa.int32()), pa.array(upper), _lists(lower, pa.float64())], ["vec_id", "v", "cluster", "upper", "lower"])

    return df.mapInArrow(work, STATE)


def _sums(df: DataFrame, k: int, width: int) -> tuple[np.ndarray, list[list[int]]]:
    """Vectors of each cluster, and the sums of their components; each task sends what it has summed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            v, cluster = _rows(b.column("v"), width).astype(np.int64), b.column("cluster").to_numpy()
            for j in range(k):
                mine = cluster == j
                count[j] += mine.sum()
                total[j] += v[mine].sum(0)
        j, i = np.indices((k, width)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(i, pa.int32()), pa.array(count[j]), pa.array(total.ravel())], ["j", "i", "n", "total"])

    rows = df.select("v", "cluster").mapInArrow(work, "j int, i int, n long, total long")
    count, total = np.zeros(k, object), [[0] * width for _ in range(k)]
    for r in rows.groupBy("j", "i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # k x width rows
        count[r.j], total[r.j][r.i] = r.n, int(r.total)
    return count, total


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, width: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors (vec_id, embedding) that have
    exactly `width` components, none null or non-finite; other rows give none, and other columns are not read.

    A component x counts as floor(scale * x). The first centroids are the k vectors with the smallest sha256 of
    "seed:vec_id" (all of fewer than k; a null id is written as nothing; equal ids in the order of their components). A
    round gives each vector to its nearest centroid, ties to the smaller number, and moves every centroid that has
    vectors to the floor of their mean; after `rounds` of them vectors are assigned once more. Rounds end early only
    where none of the centroids moves, as all later ones would be the same. Repeated rows count as often as they stand
    there. Vectors with a component beyond 2^27 after scaling are left out, as a squared distance may not fit a long.
    An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    scratch.small_batches(spark)
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    fine = F.col("embedding").isNotNull() & (F.size("embedding") == width)
    fine &= F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < LARGEST))
    kept = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<int>").alias("v"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.withColumn("key", key).orderBy("key", "v").limit(k).collect()  # k rows
    done = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], done)
    centroids = np.array([r.v for r in first], np.int64)
    k, bounds, state = len(centroids), Bounds(centroids), scratch.written(kept, "vectors")
    for _ in range(rounds):
        # Written once a round: the sums and the next round read it, and a lost executor costs no earlier round.
        state = scratch.written(_assigned(state, bounds), "bounds")
        count, total = _sums(state, k, width)
        moved = np.array([[t // int(n) for t in ts] if n else c.tolist() for n, ts, c in zip(count, total, centroids, strict=True)], np.int64)
        settled = (moved == centroids).all()
        bounds, centroids = Bounds(moved, centroids), moved
        if settled:
            break
    final = [",".join(map(str, c)) for c in centroids.tolist()]
    named = spark.createDataFrame([(j, hashlib.sha256(s.encode()).hexdigest(), centroids[j].tolist()) for j, s in enumerate(final)], "cluster int, centroid_sha256 string, c array<long>")
    apart = F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, d: s + d)
    held = scratch.written(_assigned(state, bounds).select("vec_id", "cluster", "v").join(F.broadcast(named), "cluster").select("vec_id", "cluster", apart.alias("distance"), "centroid_sha256"), "distances")  # k rows
    each = held.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    each = each.crossJoin(F.broadcast(held.agg(F.sum("distance").alias("inertia"))))  # one row
    return held.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def cluster_sql(k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, width: int = 64) -> str:
    """The same over a table `embeddings`, without bounds: every vector meets every centroid in every round."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs({scale} * x::DOUBLE) >= {LARGEST})) = 0)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS j, v AS c FROM (SELECT v, sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM kept ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, v, min_by(j, (d, j)) AS j, min(d) AS d FROM (SELECT r, vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{i}) GROUP BY r, vec_id, v)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT j, list(m ORDER BY p) AS c FROM (SELECT j, p, ((t - ((t % n) + n) % n) // n)::BIGINT AS m FROM
(SELECT j, p, sum(x)::BIGINT AS t, count(*) AS n FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i}) GROUP BY j, p)) GROUP BY j) m USING (j))""")
    last = f"a{rounds}"
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, {last}.j AS cluster, d AS distance, (sum(d) OVER (PARTITION BY {last}.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} ON c{rounds}.j = {last}.j"""
