"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and odd columns."""

import collections
import hashlib
import random
import re
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomlens.llm import catalogue, chat_format, decontaminate, embedding_dedup, licenses, mixing, ngram_join, pii, quality, url_filter, warc, words

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string, n int, sid string, a string, b string, token string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, "x", "x", "x", "x") for i, t, s in rows], DOC)


def corpus(rng, n=120):
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of"] * 40
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.5:
            w = list(rng.choice(base))
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))]
            base.append(w)
        rows.append((i, " ".join(w), f"s{i % 4}"))
    return rows + [(1000, None, None), (1001, "", "s1"), (1002, " \t\n", "s1"), (1003, "One", "s0"), (1004, "one", "s0"), (1004, "one", "s0"), (1005, "a B", None), (None, rows[0][1], "s0"), (1006, "long " * 30000, "s2")]


@pytest.fixture(scope="module")
def rows():
    return corpus(random.Random(5))


def test_words_are_those_of_a_plain_split():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB \n\té😀x") for _ in range(rng.randrange(30))).encode() for _ in range(300)] + [b"", b" ", b"x" * 3_000_000]
    import pyarrow as pa

    seen = {}
    for i, h, at in words.batches(pa.array(texts, pa.binary()), words.table(words.WHITE)):
        for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            want = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in texts[i + k].split()]
            assert b - a == len(want)
            for x, w in zip(h[a:b].tolist(), want, strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def groups(rows, k, t):
    sets = []
    for i, text, _ in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and Fraction(common, len(sets[i] | sets[j])) >= t:
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return [(r[0], len(sets[i]), min(least[find(i)], default=None)) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("k", "t", "hot"), [(3, Fraction(9, 10), ngram_join.HOT), (5, Fraction(4, 5), 3)])
def test_ngram_join(spark, rows, k, t, hot, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    got = [tuple(r) for r in ngram_join.ngram_jaccard_join(docs(spark, rows), k, t).collect()]
    assert sorted(got, key=str) == sorted(groups(rows, k, t), key=str)
    assert ngram_join.ngram_jaccard_join(docs(spark, []), k, t).collect() == []


def test_ngram_join_deals_out_long_lists(spark, monkeypatch):
    """Sets that share an element but form many groups: long lists stay mixed, and every two parts must meet."""
    rng = random.Random(9)
    rows = []
    for group in range(12):
        words_ = [f"g{group}w{i}" for i in range(20)]
        rows += [(len(rows) + j, " ".join(["same start here"] + [w if rng.random() > 0.05 else "x" for w in words_]), None) for j in range(rng.randrange(1, 9))]
    rng.shuffle(rows)
    want = sorted(groups(rows, 1, Fraction(7, 10)), key=str)
    for hot in (1, 4):
        monkeypatch.setattr(ngram_join, "HOT", hot)
        assert sorted([tuple(r) for r in ngram_join.ngram_jaccard_join(docs(spark, rows), 1, Fraction(7, 10)).collect()], key=str) == want


def test_url_filter(spark):
    urls = ["https://A.example.com/en/25#top", "http://example.com/en/7x", "https://example.net/de/80", "http://x.net/de/", "ftp://o.org/es/", "http://notexample.com/fr", None, "no url", "http://h?q=://z/en/", "http://bad-host.example/x", ""]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(3, urls[3], "x")] + [(100 + i, f"http://www{i}.spam.test/en{i}?id={i}", "x") for i in range(40)] + [(200 + i, f"http://www{i}.fine.test/en{i}", "x") for i in range(40)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(100 + i, 0, 0) for i in range(20)] + [(200 + i, 1, 0) for i in range(20)] + [(200, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, labels).collect()}
    want = {0: ("a.example.com", "/en/25", "com/en/", "block"), 1: ("example.com", "/en/7x", "example.com/en/7", "allow"), 2: ("example.net", "/de/80", "example.net/de/8", "allow"), 3: ("x.net", "/de/", "net/de/", "block"), 4: ("o.org", "/es/", "org/es/", "block"), 5: ("notexample.com", "/fr", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("h", "", None, "allow"), 10: ("", "", None, "allow")}
    for i, w in want.items():
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == w, i
    assert all(got[100 + i].verdict == "block" for i in range(40))  # learned from half of them
    assert all(got[200 + i].verdict == "allow" for i in range(40))
    assert url_filter.filter_urls(pages, labels).count() == pages.count()
    assert url_filter.filter_urls(pages.limit(0), labels.limit(0)).collect() == []


def test_license_scan(spark):
    texts = {1: "All rights reserved. CC-BY! cc by cc by", 2: "GNU General Public License", 3: None, 4: "", 5: "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0", 6: "SPDX-License-Identifier: MIT AND", 7: "xcc by", 8: "x " * 50000 + "all\nrights  reserved é"}
    got = {r.doc_id: r for r in licenses.license_scan(docs(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert (got[i].n_words, got[i].n_base) == (len(w), len(places))
        assert (got[i].first_word, got[i].last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert got[i].base_labels == ",".join(sorted({x for _, x in places}))
        assert 0 <= got[i].score <= 1
    assert set(got[5].labels.split(",")) == {"mit", "apache-2.0", "gpl-2.0-with-classpath-exception-2.0"}
    assert (got[5].score, got[6].score) == (0.6, 0.0)
    assert licenses.evaluate("MIT OR GPL-3.0 AND AGPL-3.0")[1] == 1.0
    assert licenses.evaluate("(MIT OR GPL-3.0) AND AGPL-3.0")[1] == 0.3
    assert [licenses.evaluate(x) for x in ("", "(MIT", "MIT)", "AND MIT", "MIT MIT", "(MIT OR ISC) WITH x", "MIT / ISC")] == [None] * 7
    assert licenses.license_scan(docs(spark, [])).collect() == []


def test_preferences(spark):
    schema = "pair_id long, turn long, role string, text string, cut string"
    a = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "yes", ""), (1, 2, "user", "so", ""), (2, 0, "user", None, ""), (3, None, "system", "s", ""), (3, 0, "user", "u", ""), (3, 0, "user", "u", ""), (None, 0, "user", "x", "")]
    b = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "no", ""), (2, 0, "user", "", ""), (3, None, "system", "s", ""), (3, 0, "user", "u", "")]
    got = sorted((r.pair_id, r.part, str(r.turn), r.nth, r.rendered, r.rendered[r.learn_from : r.learn_to]) for r in chat_format.format_preferences(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect())
    assert got == sorted([
        (1, "prompt", "0", 1, "<|user|>\nhi<|end|>\n", ""), (1, "chosen", "1", 1, "<|assistant|>\nyes<|end|>\n", "yes<|end|>\n"), (1, "chosen", "2", 1, "<|user|>\nso<|end|>\n", ""),
        (1, "rejected", "1", 1, "<|assistant|>\nno<|end|>\n", "no<|end|>\n"), (2, "prompt", "0", 1, "<|user|>\n<|end|>\n", ""), (3, "prompt", "None", 1, "<|system|>\ns<|end|>\n", ""),
        (3, "prompt", "0", 1, "<|user|>\nu<|end|>\n", ""), (3, "chosen", "0", 2, "<|user|>\nu<|end|>\n", ""),
    ])
    none = spark.createDataFrame([], schema)
    assert chat_format.format_preferences(none, none).collect() == []


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - (9 if int(c) > 4 else 0) for k, c in enumerate(reversed(d))) % 10 == 0


def personal(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 2, "card", m.end())] if 12 <= len(d) <= 19 and luhn(d) else []
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_personal_data(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab1.@ +-()0😀é9%\n2.5") for _ in range(rng.randrange(0, 60))), "s") for i in range(1500)]
    rows += [(5000, None, "s"), (5001, "", "s"), (5002, "9" * 30000, "s"), (5003, "a" * 30000 + "@", "s"), (5004, "1 " * 20000, "s"), (5005, "0000.1.2.3 4381 8935-5774 1609 +1 (523) 555-1055", "s"), (5005, "0000.1.2.3", "s")]
    table = docs(spark, rows)
    want = collections.Counter((i, hashlib.sha256(",".join(personal(t or "")).encode()).hexdigest()) for i, t, _ in rows)
    got = pii.find_personal_data(table).collect()
    assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == want
    text = dict((i, t) for i, t, _ in rows[:1500])
    for r in got:
        if r.doc_id < 1500:
            assert set(personal(text[r.doc_id])) <= set(filter(None, r.spans.split(",")))
    assert pii.find_personal_data(docs(spark, [])).collect() == []


def test_contexts_find_new_identifiers(spark):
    rows = [(i, f"please mail contact a{i}@x.example thanks", "s") for i in range(10)] + [(50 + i, f"in {i}{i}abc{i}77 we trust", "s") for i in range(10)] + [(90, "please mail contact user#4411998 thanks", "s"), (91, "seen user#4411998 here", "s")]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(docs(spark, rows)).collect()}
    assert got[90] == "id:20:32" and got[91] == "" and not any("id:" in got[50 + i] for i in range(10))
    out = {r.doc_id: r.text for r in pii.redact_personal_data(docs(spark, [*rows, (99, None, "s")])).collect()}
    assert (out[90], out[0], out[99], out[91]) == ("please mail contact [ID] thanks", "please mail contact [EMAIL] thanks", None, rows[-1][1])


def test_mixing(spark, rows):
    got = mixing.mix_sources(docs(spark, rows)).collect()
    size = collections.Counter()
    source = {(i, len((t or "").encode().split())): s for i, t, s in rows}
    for i, t, s in rows:
        size[s] += len((t or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight, rest, target, free = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, sum(size.values()), {}, set(order)
    while over := [s for s in free if rest * weight[s] > 3 * size[s] * sum(weight[x] for x in free)]:
        for s in over:
            target[s] = 3 * size[s]
        free -= set(over)
        rest -= sum(target[s] for s in over)
    target |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
    taken, most = collections.Counter(), collections.Counter()
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == collections.Counter((i, len((t or "").encode().split())) for i, t, _ in rows)
    for r in got:
        s = source[(r.doc_id, r["size"])]
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 and r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[s] += r.taken
        most[s] = max(most[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] for s in size)
    again = mixing.mix_sources(docs(spark, rows).repartition(5)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert mixing.mix_sources(docs(spark, [])).collect() == []


def test_rounding_keeps_expectations(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(300)]
    mean = np.mean([[r.taken / r["size"] for r in sorted(mixing.mix_sources(docs(spark, rows), seed=s).collect())] for s in range(6)])
    c = {r.doc_id: r.target / r.source_size for r in mixing.mix_sources(docs(spark, rows)).collect()}
    assert abs(mean - np.mean(list(c.values()))) < 0.1


def word_edits(x, t):
    last = [0] * (len(t) + 1)
    for i in range(1, len(x) + 1):
        now = [i]
        for j in range(1, len(t) + 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x[i - 1] != t[j - 1])))
        last = now
    return min(last)


def test_decontamination(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(40)] + [(40, None), (41, ""), (None, "x y"), (0, "again " * 9)]
    texts = []
    for i, t in items[:40] * 3:
        w = t.split()
        for _ in range(rng.randrange(0, len(w) // 4 + 1)):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(2)] = [word().upper()] * rng.randrange(1, 2)
        texts.append((len(texts), " ".join(word() for _ in range(30)) + ", " + " ".join(w) + ". " + " ".join(word() for _ in range(30)), "s"))
    texts += [(900, None, "s"), (901, "", "s"), (902, "long " * 40000, "s"), (902, "long", "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, set(r.item_ids)) for r in decontaminate.decontaminate(docs(spark, texts), bench).collect()]
    assert len(got) == len(texts)
    found = dict(got)
    hit = want = 0
    for d, t, _ in texts[:120]:
        w = re.findall("[a-z0-9]+", t.lower())
        true = {i for i, x in items if i is not None and x and word_edits(x.split(), w) <= len(x.split()) * 2 // 10}
        assert found[d] <= true
        hit, want = hit + len(found[d]), want + len(true)
    assert hit >= 0.98 * want and want > 80
    clean = decontaminate.drop_leaks(docs(spark, texts), bench).collect()
    assert collections.Counter(r.doc_id for r in clean) == collections.Counter(d for d, x in got if not x)
    assert [r.n_items for r in decontaminate.decontaminate(docs(spark, texts[:1]), bench.limit(0)).collect()] == [0]
    assert decontaminate.decontaminate(docs(spark, []), bench).collect() == []


def test_warc(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/\n x", big), (2, None, big), (3, "http://b/é", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "z" * 1000), (7, "u", "z" * 1000), (8, "u", "y" * 300_000), (None, "u", big)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, kind int, digest string")
    folder = str(tmp_path / "warc")
    manifest = warc.write_warc(pages, folder, roll_bytes=700)
    got = warc.read_warc(manifest, folder, payloads=True).collect()
    assert collections.Counter((r.page_id, r.record_type, r.refers_to) for r in got) == collections.Counter([(1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (7, "revisit", 7), (8, "response", None), (None, "revisit", 2)])
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(html[r.page_id]), hashlib.sha1(html[r.page_id]).hexdigest())
        assert r.record_type == "revisit" or r.payload == html[r.page_id]
    files = manifest.collect()
    assert len(files) > 1 and all(hashlib.sha1((tmp_path / "warc" / f.file).read_bytes()).hexdigest() == f.sha1 for f in files)
    twice = warc.write_warc(pages.coalesce(1), str(tmp_path / "again"), roll_bytes=700).collect()
    assert {(f.file, f.sha1) for f in twice} == {(f.file, f.sha1) for f in files}
    assert warc.read_warc(warc.write_warc(pages.limit(0), str(tmp_path / "none")), str(tmp_path / "none")).collect() == []


def test_quality(spark):
    rng = random.Random(4)
    good = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) for _ in range(40)), "s") for i in range(300)]
    bad = [(1000 + i, " ".join("X" * rng.randrange(2, 6) + "!!" for _ in range(40)), "s") for i in range(100)]
    table = docs(spark, [*good, *bad, (5000, None, "s"), (5001, "", "s"), (5001, "", "s"), (None, "alpha", "s")])
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in bad] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.quality_classifier(table, labels).collect()
    import zlib

    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r.predicted == (r.doc_id < 1000) for r in got if r.held_out and r.doc_id < 5000]
    assert np.mean(held) > 0.98
    assert {r.score for r in quality.quality_classifier(table, labels.limit(0)).collect()} == {0.5}


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(60):
        base = rng.standard_normal(64)
        rows += [(len(rows) + k, (base + (0.1 * rng.standard_normal(64) if k else 0)).tolist(), i % 3, "x") for k in range(rng.integers(1, 6))]
    n = len(rows)
    rows += [(9000, rows[0][1], rows[0][2], "x"), (9001, rows[0][1], None, "x"), (9002, None, 1, "x"), (9003, [0.0] * 64, 1, "x"), (9004, [float("nan")] * 64, 1, "x"), (9005, [None] * 64, 1, "x"), (9006, [1.0], 1, "x"), (9000, rows[0][1], rows[0][2], "x"), (9007, [], 1, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_near_dedup(table, block=3).collect())
    x = np.array([np.float32(r[1]) for r in rows[:n]] + [np.float32(rows[0][1])] * 2, float)
    ids, label = [*range(n), 9000, 9000], np.array([r[2] for r in rows[:n]] + [rows[0][2]] * 2)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    comp = list(ids)
    for _ in range(10):
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
    links = near.sum(1)
    want = sorted([(ids[i], int(links[i]), comp[i], ids[i] == comp[i]) for i in range(len(x))] + [(r[0], 0, r[0], True) for r in rows[n:] if r[0] != 9000])
    assert sum(g[1] for g in got) >= 0.95 * links.sum() and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert [g[0] for g in got] == [w[0] for w in want]
    if sum(g[1] for g in got) == links.sum():
        assert got == want
    assert embedding_dedup.embedding_near_dedup(table.limit(0)).collect() == []


def pairs_at(rng, n, cosine, mean=0.0, width=64):
    """n pairs of vectors at a cosine, about a common direction that gives others a cosine of `mean`."""
    x = rng.standard_normal((n, width))
    x = np.sqrt(1 - mean) * x / np.linalg.norm(x, axis=1, keepdims=True)
    x[:, 0] += np.sqrt(mean)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.standard_normal((n, width))
    off -= (off * x).sum(1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    return np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * off])


def links_found(spark, x, **how):
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = sum(r.n_links for r in embedding_dedup.embedding_near_dedup(table, **how).collect())
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return got, ((y @ y.T >= how.get("threshold", 0.98)) & ~np.eye(len(y), dtype=bool)).sum()


def test_embedding_recall_with_long_keys(spark, monkeypatch):
    """Keys of 16 bits, as a table of many vectors has them, find pairs at the threshold as others do."""
    planned = embedding_dedup.plan_tables
    monkeypatch.setattr(embedding_dedup, "plan_tables", lambda x, label, others, *a: planned(x, label, 4e7, *a))
    x = pairs_at(np.random.default_rng(3), 1000, 0.9801)
    assert planned(x, np.zeros(len(x)), 4e7, 0.98)[0] >= 16
    got, want = links_found(spark, x)
    assert want == 2000 and 0.998 * want <= got <= want


def test_embedding_recall_about_a_common_direction(spark):
    """Vectors that share a direction keep their links: centred, the angle of such pairs is several times as wide."""
    got, want = links_found(spark, pairs_at(np.random.default_rng(4), 1000, 0.9801, mean=0.9))
    assert want >= 2000 and 0.998 * want <= got <= want


def test_embedding_probes(spark, monkeypatch):
    """Keys with probed neighbours find each pair once, with and without split buckets."""
    planned, plans = embedding_dedup.plan_tables, []
    x = pairs_at(np.random.default_rng(5), 300, 0.9801, mean=0.5, width=32)

    def probing(few, label, others, *a):
        plans.append(planned(few, label, 4e5, *a, probing=(1,)))
        return plans[-1]

    monkeypatch.setattr(embedding_dedup, "plan_tables", probing)
    for block in (32, 1024):
        got, want = links_found(spark, x, block=block)
        assert plans[-1].probes == 1 and plans[-1].bits >= 8 and plans[-1].radius < plans[-1].normals.shape[1]
        assert want >= 600 and 0.995 * want <= got <= want


@pytest.mark.parametrize("width, others", [(64, 1e8), (384, 1e7)])
def test_embedding_plans_reach_vectors_they_have_not_seen(width, others):
    x, y = (pairs_at(np.random.default_rng(seed), 1500, 0.98, width=width) for seed in (1, 2))
    plan = embedding_dedup.plan_tables(x, np.zeros(len(x)), others, 0.98)
    one, other = (embedding_dedup._sides(v, plan) for v in (y[:1500], y[1500:]))
    one_key, other_key = (embedding_dedup._keys(s, plan.bits, plan.tables) for s in (one, other))
    meet = (np.bitwise_count(one_key ^ other_key) <= plan.probes).any(1) & ((one != other).sum(1) <= plan.radius)
    assert meet.mean() >= 0.998 and ((one[1:] != one[:-1]).sum(1) > plan.radius).mean() > 0.99


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    first = spark.read.parquet(f"{SF}/documents.parquet")
    before, kept = first, []
    for name, stage in cp.STAGES:
        after = stage(spark, before, SF)
        kept.append(after)
        if name != "mixing":
            assert tuple(after.columns) == cp.COLUMNS
            after = after.persist()
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text, "") for r in before.collect()]
            assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, _, low in groups(rows, 5, Fraction(4, 5)) if i == low)
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not [1 for r in after.collect() for x in items if x in r.text]
        if name == "personal_data":
            assert after.count() == before.count()
            assert not [1 for r in after.collect() if any(x.startswith("email") for x in personal(r.text))]
        before = after
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, kept[-1].collect()))


def test_queries_run_on_whole_tables(spark):
    for name, rows in {"op3_license_scan": "documents", "op7_decontaminate": "documents", "op8_warc_archive": "pages", "op10_embedding_dedup": "embeddings"}.items():
        assert catalogue.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{rows}.parquet").agg(F.count("*")).first()[0]


def test_one_of_each_is_kept(spark):
    """Unlike texts that share an id, or have none, stay; of equal rows and near copies one does; blank texts all do."""
    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w59", "other")
    rows = [(7, long, "a"), (7, "quite another text of seven words here", "b"), (None, "one two three four five six", "c"), (None, "no relation to any of the others", "d"), (None, None, "e"), (None, None, "e"), (3, near, "f"), (3, near, "f"), (9, long, "g"), (None, long, "h"), (11, "", "i"), (12, "Short", "j"), (13, "short", "k")]
    got = collections.Counter((r.doc_id, r.text, r.source) for r in ngram_join.keep_one_of_each(docs(spark, rows)).collect())
    gone = [(7, long, "a"), (3, near, "f"), (9, long, "g"), (None, long, "h"), (13, "short", "k")]
    assert got == collections.Counter(rows) - collections.Counter(gone)
    assert ngram_join.keep_one_of_each(docs(spark, [])).collect() == []


def edited(rng, w, n, voc):
    w = list(w)
    for _ in range(n):
        k, kind = rng.randrange(len(w)), rng.randrange(3)
        w[k : k + (kind != 1)] = [rng.choice(voc)] if kind < 2 else []
    return w


@pytest.mark.parametrize("n", [5, 48, 49, 100, 400, 1000, 5000])
def test_long_benchmark_items_are_found(n):
    """At the limit of edits, recall does not fall with an item's length."""
    import pyarrow as pa

    rng, m = random.Random(n), 60 if n <= 1000 else 8
    voc = [f"w{i}" for i in range(5000)]
    items = [[rng.choice(voc) for _ in range(n)] for _ in range(m)]
    ix = decontaminate.Index(list(range(m)), [" ".join(x).encode() for x in items], 0.8, 0.99)
    texts = [" ".join([*rng.choices(voc, k=60), *edited(rng, x, n // 5, voc), *rng.choices(voc, k=60)]).encode() for x in items]
    found = {(i + d, k) for i, h, at in words.batches(pa.array(texts, pa.binary()), decontaminate.HOW) for d, k in ix.found(h, at)}
    assert sum((i, i) in found for i in range(m)) >= 0.97 * m


def test_benchmark_items_are_compared_exactly_where_walks_fail():
    """No repetitions reach the recall asked for: every place is compared."""
    import pyarrow as pa

    rng = random.Random(8)
    voc = [f"w{i}" for i in range(40)]
    items = [[rng.choice(voc) for _ in range(12)] for _ in range(5)]
    ix = decontaminate.Index(list(range(5)), [" ".join(x).encode() for x in items], 0.8, 1.01)
    assert all(not len(b["salts"]) for b in ix.bands)
    texts = [" ".join([*rng.choices(voc, k=9), *edited(rng, items[i % 5], i % 4, voc), *rng.choices(voc, k=9)]) for i in range(60)]
    found = {(i + d, k) for i, h, at in words.batches(pa.array([t.encode() for t in texts], pa.binary()), decontaminate.HOW) for d, k in ix.found(h, at)}
    assert found == {(i, k) for i, t in enumerate(texts) for k in range(5) if word_edits(items[k], t.split()) <= 2}


def test_embeddings_of_several_widths_and_in_doubles(spark):
    rng = np.random.default_rng(9)
    rows = []
    for width in (3, 7, 16):
        x = pairs_at(rng, 20, 0.985, width=width)
        rows += [(100 * width + i, (v * 1e200).tolist(), 1) for i, v in enumerate(x)]
    # A hair below and a hair above the threshold: only doubles can tell.
    t = 0.98
    rows += [(1, [1.0, 0.0], 2), (2, [t + 1e-12, float(np.sqrt(1 - (t + 1e-12) ** 2))], 2), (3, [t - 1e-10, -float(np.sqrt(1 - (t - 1e-10) ** 2))], 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_near_dedup(table).collect()}
    for i, v, k in rows:
        x, ids = np.array([np.array(w) / np.abs(w).max() for _, w, l in rows if l == k and len(w) == len(v)]), [j for j, w, l in rows if l == k and len(w) == len(v)]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert got[i][0] == (x[ids.index(i)] @ x.T >= 0.98).sum() - 1


def test_learned_codes_are_balanced():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 24)) * np.linspace(0.2, 3, 24) + 1
    centred = x - x.mean(0)
    r = embedding_dedup.learn_rotation(centred, rng)
    assert np.allclose(r @ r.T, np.eye(24)) and abs((centred @ r >= 0).mean(0) - 0.5).max() < 0.06
    loss = lambda q: ((np.where(centred @ q >= 0, 1, -1) - centred @ q) ** 2).sum()
    assert loss(r) < loss(np.linalg.qr(rng.standard_normal((24, 24)))[0])


def test_pattern_graph_scores(spark):
    """Scores and trust against a plain computation of the same rounds."""
    rng = random.Random(4)
    edges = sorted({(f"p{rng.randrange(12)}", f"i{rng.randrange(30)}") for _ in range(90)})
    seeds, made = {f"i{i}" for i in range(6)}, {f"i{i}" for i in range(4, 14)}
    graph = spark.createDataFrame([(p, i, i in seeds, i in made) for p, i in edges], "pattern string, inst string, seed boolean, made boolean")
    scored, trusted = (dict(map(tuple, x.collect())) for x in pii.score_graph(graph, 3, 0.6, 2))
    start = {i: 1.0 if i in seeds else 0.5 if i in made else 0.0 for _, i in edges}
    trust = dict(start)
    some = lambda xs: 1 - np.prod([max(1 - x, 1e-9) for x in xs]) if xs else 0.0
    for _ in range(3):
        scores = {}
        for p in {p for p, _ in edges}:
            xs = [trust[i] for q, i in edges if q == p]
            k = sum(x >= 0.5 for x in xs)
            score = k / len(xs) * some(xs)
            if k >= 2 and score >= 0.3:
                scores[p] = score
        trust = {i: max(start[i], some([scores[p] for p, j in edges if j == i and p in scores])) for i in start}
    assert scored.keys() == scores.keys() and all(abs(scored[p] - scores[p]) < 1e-6 for p in scores)
    assert trusted.keys() == trust.keys() and all(abs(trusted[i] - trust[i]) < 1e-6 for i in trust)


def test_secrets_are_found_by_their_patterns(spark):
    rng = random.Random(6)
    run = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    word = lambda: run(6, "abcdefghij")
    rows = [(i, f'{word()} token = "{run(40, "0123456789abcdef")}" {word()} {word()}', "s") for i in range(12)]
    rows += [(100 + i, f"{word()} {word()} pw={run(18, '0123456789abcdef')} {word()}", "s") for i in range(12)]
    rows += [(200 + i, f"{word()} {word()} KEYX{run(16, 'ABCDEFGHIJKLMNOP23456')} {word()}", "s") for i in range(12)]
    rows += [(300 + i, f"{word()} in 2021{i:02d} and {word()} chapter{i}seven {word()}", "s") for i in range(12)]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(docs(spark, rows)).collect()}
    for i, t, _ in rows:
        m = re.search(r"[0-9a-f]{18,}|KEYX\w+", t)
        assert got[i] == (f"id:{m.start()}:{m.end()}" if i < 300 else ""), (t, got[i])


def test_url_rules_against_plain_counting(spark):
    """Every combination of tokens, counted; rules by support, confidence and cover; verdicts by trying all rules."""
    import itertools

    rng = random.Random(12)
    urls = [f"http://{rng.choice('ab')}.{rng.choice('xyz')}.test/{rng.choice(['p', 'q'])}/{rng.choice(['u', 'v', 'w'])}" for _ in range(400)]
    bad = [("a.x" in u or "/q/w" in u) ^ (rng.random() < 0.1) for u in urls]
    table = spark.createDataFrame(list(zip(urls, bad)), "url string, bad boolean")
    rules = url_filter.mine_rules(table.select("url"), table, support=0.02, least=5, confidence=0.75)
    got = {tuple(r["items"]): r.confidence for r in rules.collect()}
    items = {r.url: frozenset(r.t) for r in table.select("url", url_filter.tokens(F.col("url")).alias("t")).distinct().collect()}
    every = frozenset.intersection(*(items[u] for u in urls))
    count, wrong = collections.Counter(), collections.Counter()
    for u, b in zip(urls, bad):
        rest = sorted(items[u] - every)
        for n in range(1, len(rest) + 1):
            for c in itertools.combinations(rest, n):
                count[c] += 1
                wrong[c] += b
    good = {c: wrong[c] / count[c] for c in count if wrong[c] >= 8 and wrong[c] / count[c] >= 0.75}
    want = {c: x for c, x in good.items() if not any(set(d) < set(c) and good[d] >= x for d in good)}
    assert got.keys() == want.keys() and want and all(abs(got[c] - want[c]) < 1e-9 for c in want)
    hits = {r.url: r.confidence for r in url_filter.match_rules(table, rules).collect()}
    best = {u: max((x for c, x in want.items() if set(c) <= items[u]), default=None) for u in items}
    assert hits == {u: x for u, x in best.items() if x is not None}


def test_quality_updates_against_a_dense_reference():
    """The same updates written out over whole vectors."""
    rng = np.random.default_rng(1)
    examples = []
    for _ in range(40):
        index = np.sort(rng.choice(50, 6, replace=False))
        examples.append((int(rng.integers(0, 2)), index.astype(np.int32), rng.random(6).astype(np.float32)))
    got = quality.fit(examples, epochs=2)
    d = quality.DIMENSIONS + 1
    z, n = np.zeros(d), np.zeros(d)
    for _ in range(2):
        for y, index, v in examples:
            x = np.zeros(d)
            x[index], x[-1] = v, 1
            w = np.where(np.abs(z) <= 1e-3, 0, -(z - np.sign(z) * 1e-3) / ((1 + np.sqrt(n)) / 0.5 + 1e-4))
            g = (1 / (1 + np.exp(-(w @ x))) - y) * x
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / 0.5 * w
            n += g * g
    want = np.where(np.abs(z) <= 1e-3, 0, -(z - np.sign(z) * 1e-3) / ((1 + np.sqrt(n)) / 0.5 + 1e-4))
    assert np.allclose(got, want, atol=1e-9)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated ids and rows, empty and long texts, and an empty table."""
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long, text_2 string"
    odd = [(None,) * 6, (None,) * 6, (1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (2, "two words", None, None, 9, "x"), (None, "mail a@b.example now", "en", None, 20, "x"), (4, "long " * 30000, "en", "s", None, "x"), (4, "long " * 30000, "en", "s", None, "x")]
    for name, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([(None, None, None)[: kind.count(",") + 1]], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    for rows in (odd, []):
        now = spark.createDataFrame(rows, schema)
        for name, stage in cp.STAGES:
            out = stage(spark, now, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{name}-{len(rows)}")
            now = spark.read.parquet(f"{tmp_path}/{name}-{len(rows)}")
            assert now.count() == (len(rows) if name == "quality" or not rows else len(rows) - 1), name


@pytest.mark.parametrize("chunk", [3, 1 << 17])
def test_components_against_plain_search(spark, chunk):
    from loomlens.llm import graph

    rng = random.Random(chunk)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5), (None, 7)]
    low = {x: x for e in edges[:-2] for x in e}
    for _ in low:
        for a, b in edges[:-2]:
            low[a] = low[b] = min(low[a], low[b])
    alone = {a for a, b in edges[:-2] if a == b} - {x for a, b in edges[:-2] if a != b for x in (a, b)}
    got = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(4), chunk=chunk).collect()
    assert {r.node: r.component for r in got} == {x: c for x, c in low.items() if x not in alone} and len({r.node for r in got}) == len(got)


def _group(rng, n):
    """Variants of one text, most of them about as similar to each other as the threshold asks for; and unlike long texts
    that share a phrase."""
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(n):
        w = list(base)
        for j in range(3 + i % 2):
            w[rng.randrange(len(w))] = f"v{i}.{j}"
        rows.append((i, " ".join(w), "s0"))
    for i in range(n // 4):
        rows.append((5000 + i, " ".join(["one phrase that all share", *(f"u{i}.{j}" for j in range(2500))]), "s0"))
    return rows


def test_pairs_grow_with_a_group_of_near_copies(spark, monkeypatch):
    made, plausible = [], ngram_join._plausible
    monkeypatch.setattr(ngram_join, "_plausible", lambda pairs, *x: made.append(pairs.count()) or plausible(pairs, *x))
    counts = []
    for n in (60, 240):
        made.clear()
        rows = _group(random.Random(3), n)
        got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(docs(spark, rows), 5, Fraction(4, 5)).collect()}
        sets = [(i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)}) for i, t, _ in rows for w in [t.split()]]
        want = {i: i for i, _ in sets}
        for x, (a, s) in enumerate(sets):
            for b, u in sets[:x]:
                if 5 * len(s & u) >= 4 * len(s | u) and want[a] != want[b]:
                    old, new = max(want[a], want[b]), min(want[a], want[b])
                    want = {i: new if c == old else c for i, c in want.items()}
        assert got == want
        counts.append(sum(made))
    assert counts[1] <= 6 * counts[0], counts


def _entries(texts, labels):
    """One index list of all the texts' sets, as the join lays it."""
    rows = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts], pa.binary())], ["text"])
    made = pa.Table.from_batches(ngram_join._bitmaps(iter([rows]), 5, SimpleNamespace(value=np.full(1 << 15, 255, np.uint8)))).to_pylist()
    made = sorted(({"token": 1, "part": 0, "sid": r["sid"], "n": r["n"], "pos": 0, "bits": r["bits"], "label": labels[i]} for i, r in enumerate(made)), key=lambda r: (r["n"], r["sid"]))
    return pa.RecordBatch.from_pylist(made)


def test_unlike_long_sets_of_a_list_make_no_pairs():
    entries = _entries([" ".join(f"u{i}.{j}" for j in range(3000)) for i in range(20)], range(20))
    assert sum(map(len, ngram_join._compared(iter([entries]), Fraction(4, 5), ngram_join.ALL))) == 0


def test_a_set_apart_from_its_group_is_offered_one_pair():
    texts = [" ".join(f"v{i}" if j == 7 * i else f"b{j}" for j in range(300)) for i in range(40)]
    entries = _entries(texts, [0] * 39 + [1])
    made = {how: sum(map(len, ngram_join._compared(iter([entries]), Fraction(4, 5), how))) for how in (ngram_join.NEAREST, ngram_join.ALL)}
    assert made == {ngram_join.NEAREST: 1, ngram_join.ALL: 39}
