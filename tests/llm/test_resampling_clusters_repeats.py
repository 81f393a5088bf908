"""Importance resampling, centroid clustering and repeat removal against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomlens.llm import catalogue, centroids, repeats, resampling

SF = "/root/testdata/sf0.001"
# Columns that clash with names used inside.
DOC = "doc_id long, text string, score long, tag long, rank long, buckets string, _part int, spans string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "x", 4, "y") for i, t in rows], DOC)


def sql_rows(name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        con.register(t, rows) if isinstance(rows, pa.Table) else con.execute(f"create view {t} as select * from '{rows}'")
    found = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    return sorted((tuple(r[i] for i in np.argsort(names)) for r in found.fetchall()), key=repr)


def spark_rows(df):
    order = np.argsort(df.columns).tolist()
    return sorted((tuple(r[i] for i in order) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name, tables", [("op11_importance_resampling", ["documents", "benchmark"]), ("op12_centroid_clustering", ["embeddings"]), ("op13_suffix_array_dedup", ["documents"])])
def test_query_equals_its_sql(spark, name, tables):
    assert spark_rows(catalogue.QUERIES[name](spark, SF)) == sql_rows(name, **{t: f"{SF}/{t}.parquet" for t in tables})


# --- resampling


def resampled(rows, target, n, buckets, percent, least, seed):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(text):
        return word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    def features(w):
        return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for f in features(words(text)):
            s[bucket(f)] += 1
    for text in target:
        for f in features(words(text)):
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[i] + 1) * (sum(s) + buckets) / ((s[i] + 1) * (sum(t) + buckets)))) for i in range(buckets)]
    out = []
    for i, text in rows:
        f = features(words(text))
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= least])
    order = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(order[: percent * len(order) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


def prose(rng, n):
    vocabulary = [f"w{i}" for i in range(80)] + ["The", "É", "straße"]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, " \t!"), (None, rows[3][1]), (None, None), (7, rows[7][1]), (7, rows[7][1]), (8, "other words " * 15), (1003, "long words " * 60_000)]


@pytest.mark.parametrize("n, percent", [(1, 10), (3, 37), (2, 100)])
def test_resampling_is_that_of_a_loop(spark, n, percent):
    rng = random.Random(n)
    rows, target = prose(rng, 150), [t for _, t in prose(rng, 20)][:24]
    got = resampling.importance_resample(docs(spark, rows).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), n, 500, percent, 20, 9)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == resampled(rows, target, n, 500, percent, 20, 9)


def test_resampling_draws_towards_the_target(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["red", "green"] if i % 10 == 0 else ["blue", "grey", "black"]) for _ in range(30))) for i in range(400)]
    got = resampling.importance_resample(docs(spark, rows), docs(spark, [(0, "red green " * 50)]), 1, 100, 10).where("rank is not null").collect()
    assert len(got) == 40 and sum(r.doc_id % 10 == 0 for r in got) > 20


def test_resampling_of_nothing(spark):
    none = docs(spark, [])
    assert resampling.importance_resample(none, none).collect() == []
    got = resampling.importance_resample(docs(spark, [(1, None), (2, "a b")]), none).collect()
    assert sorted((r.doc_id, r.n_features, r.rank) for r in got) == [(1, 0, None), (2, 2, None)]


def test_a_third_of_the_rows_alike(spark):
    rows = [(5, "same words " * 15)] * 100 + [(i, f"w{i} " * 25) for i in range(200)]
    got = resampling.importance_resample(docs(spark, rows).repartition(6), docs(spark, [(1, "same words")]), percent=40)
    assert sorted(r["rank"] for r in got.where("rank is not null").collect()) == list(range(1, 121))
    assert sorted(map(tuple, got.collect()), key=repr) == resampled(rows, ["same words"], 1, 10_000, 40, 20, 2024)


# --- clusters


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, [1]) for i, v in rows], "vec_id long, embedding array<float>, cluster int, upper double, v array<int>")


def clustered(rows, k, rounds, seed, scale, width):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(v) for _, v in first]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(c)), key=lambda j: (d(v, c[j]), j))
    for _ in range(rounds):
        at = [near(v) for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = [near(v) for _, v in kept]
    far = [d(v, c[a]) for (_, v), a in zip(kept, at, strict=True)]
    return sorted(((i, a, x, sum(y for b, y in zip(at, far, strict=True) if a == b), sum(far), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, x in zip(kept, at, far, strict=True)), key=repr)


@pytest.mark.parametrize("spread", [0.0, 0.002, 0.5])
def test_clusters_are_those_of_a_loop(spark, spread):
    """With little spread, components are small integers and most distances are ties."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, spread, 6) + (i % 3) * spread * 2).tolist()) for i in range(150)]
    rows += [(5, rows[5][1]), (None, rows[1][1]), (None, rows[2][1]), (200, None), (201, []), (202, [0.5] * 5), (203, [0.5] * 7), (204, [float("nan")] + [0.0] * 5), (205, [float("-inf")] + [0.0] * 5), (206, [None] + [0.0] * 5), (207, [-0.1] * 6)]
    got = centroids.cluster_vectors(vectors(spark, rows).repartition(4), 5, 6, 3, 64, 6)
    assert sorted(map(tuple, got.collect()), key=repr) == clustered(rows, 5, 6, 3, 64, 6)


def test_few_or_no_vectors(spark):
    assert centroids.cluster_vectors(vectors(spark, [(1, None), (2, [1.0])])).collect() == []
    rows = [(i, [float(i)] * 64) for i in range(3)]
    got = centroids.cluster_vectors(vectors(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == clustered(rows, 8, 10, 3, 1024, 64)


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.integers(-40, 40, (300, 8)) + 1000 * c for c in range(6)])
    c = v[rng.choice(len(v), 6, replace=False)].copy()
    n, k = len(v), len(c)
    cluster, upper, lower, bounds = np.zeros(n, np.int32), np.zeros(n), np.zeros((n, k)), centroids.Bounds(c)
    done = []
    for _ in range(6):
        done.append(bounds.assign(v, cluster, upper, lower))
        d = np.stack([centroids.squared(v, x) for x in c], 1)
        assert (cluster == d.argmin(1)).all()
        true = np.sqrt(d.astype(np.longdouble))
        assert (lower <= true).all() and (upper >= true[np.arange(n), cluster]).all()
        moved = np.stack([np.floor_divide(v[cluster == j].sum(0), max(1, (cluster == j).sum())) if (cluster == j).any() else c[j] for j in range(k)])
        bounds, c = centroids.Bounds(moved, c), moved
    assert done[-1] < n * k / 3


# --- repeats


def covered(rows, least):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for p in range(len(b) - least + 1):
            if i is not None:
                first[b[p : p + least]] = min(i, first.get(b[p : p + least], i))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if i is not None and first[b[p : p + least]] < i:
                gone[p : p + least] = b"\1" * least
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def passages(rng, n):
    letters = "ab é"
    shared = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 200))) for _ in range(12)]
    line = "".join(rng.choice("abcdefgh ") for _ in range(70))
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randrange(90))))
            if rng.random() < 0.4:
                parts.append(line)
        rows.append((i, "".join(parts)))
    rows += [(3000, rows[4][1]), (3001, rows[4][1][1:]), (2, rows[5][1]), (2, rows[5][1]), (None, rows[6][1]), (4000, None), (4001, ""), (4002, "x" * 49), (4003, "x" * 50), (4004, "x" * 50), (4005, "x" * 4000), (4006, "ab" * 300), (-5, "ab" * 30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [1000, 5])
def test_repeats_are_those_of_a_loop(spark, monkeypatch, hot):
    """With a low bound most anchors are hot and go by their strings."""
    monkeypatch.setattr(repeats, "HOT", hot)
    for least in (50, 27):
        rows = passages(random.Random(hot + least), 120)
        got = repeats.remove_repeats(docs(spark, rows).repartition(5), least)
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()), key=repr) == covered(rows, least)


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(docs(spark, [])).collect() == []
    got = repeats.remove_repeats(docs(spark, [(1, None), (None, None)]), digest=True).collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == [(0, 0, 0, hashlib.sha256(b"").hexdigest())] * 2


def test_long_texts_go_by_pieces(monkeypatch):
    """Each string's anchor is found, wherever pieces are cut, and equal strings have equal anchors."""
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (0, 49, 50, 51, 3000, 700, 120)]
    seen = []
    for size in (64, 1 << 20):
        monkeypatch.setattr(repeats, "SLICE", size)
        found = {(int(r), int(p)): int(k) for a in repeats.anchors(pa.array(texts), 50) for r, p, k in zip(a.row, a.place, a.key, strict=True)}
        seen.append(found)
        for r, t in enumerate(texts):
            for i in range(len(t) - 49):
                assert any((r, p) in found for p in range(i, i + 31))
    assert seen[0] == seen[1]


def test_maximal_repeats_with_all_their_places():
    rng = random.Random(5)
    for least in (3, 6):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(14))) for _ in range(8)]
        places = {}
        for k, t in enumerate(texts):
            for i in range(len(t)):
                for j in range(i + least, len(t) + 1):
                    places.setdefault(t[i:j], set()).add((k, i))
        want = set()
        for s, at in places.items():
            if len(at) < 2:
                continue
            left = {texts[k][i - 1] if i else -1 - k for k, i in at}
            right = {texts[k][i + len(s)] if i + len(s) < len(texts[k]) else -1 - k for k, i in at}
            if len(left) > 1 and len(right) > 1:
                want.add((len(s), tuple(sorted(at))))
        data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        got = [(n, tuple(sorted(zip(t.tolist(), p.tolist(), strict=True)))) for n, t, p in repeats.maximal_repeats(data, at, least)]
        assert len(got) == len(set(got)) and set(got) == want
