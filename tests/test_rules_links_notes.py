"""Ignore tries against rule by rule, reported paths against comparing all, link following, and the notes sink."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomlens.operators import graph, ignore
from loomlens.sources import notes
from loomlens.sources.shared import fresh
from loomlens.sources.workspace import Ignore

LINES = ["node_modules", ".cache", "/top*/", "ext/**/dist/", ".cfg/ext/**/tmp/", "build/node_modules", "fix/data/*", "docs/**/*.tmp", "*.own.md", "a?c", "[x-z]1", "[!x]2", "**", "b/**", "**/q/r", "\\#one", "# none", "", "  ", "a\\*b", "/only"]
BASED = [("secret.txt", "p/app"), ("/made/", "p/app"), ("*.snap", "p/lib/t"), ("out", "p/lib"), ("!out/keep", "p/lib")]
UNDO = ["!fix/data/base/", "!keep.png", "!/made/keep.ts", "!**/dist", "!*"]


def paths(rng):
    words = ["node_modules", ".cache", "top1", "ext", "dist", "tmp", "build", "fix", "data", "base", "docs", "a.tmp", "x.own.md", "abc", "y1", "a2", "b", "q", "r", "#one", "a*b", "only", "p", "app", "lib", "t", "out", "keep", "secret.txt", "made", "s.snap"]
    return sorted({"/".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(600)} | {"p/app/secret.txt", "p/app/made/x", "p/lib/out/keep", "p/lib/t/s.snap", "ext/dist", "ext/a/b/dist/c"})


@pytest.mark.parametrize("undo", [0, 1, 2])
@pytest.mark.parametrize("most", [1000, 3])
def test_trie_equals_rule_by_rule(spark, undo, most):
    rng = random.Random(undo)
    rules = [(line, "") for line in LINES if line != "**"] + BASED + [(u, "p/app" if "made" in u else "") for u in UNDO[: undo * 2]]
    rng.shuffle(rules)
    plain = Ignore()
    for line, base in rules:
        plain.add(line, base)
    probes = [(p, d) for p in paths(rng) for d in (False, True)]
    table = spark.createDataFrame([(i, base, line) for i, (line, base) in enumerate(rules)], "number int, base string, line string")
    got = {(r.path, r.is_dir): r.ignored for r in ignore.ignored(spark.createDataFrame([*probes, (None, False), probes[0]], "path string, is_dir boolean"), table, most).collect()}
    assert not got.pop((None, False)) and got == {(p, d): plain.ignores(p, d) for p, d in probes}


def test_no_rules_and_globstar_alone(spark):
    table = spark.createDataFrame([("a/b", False)], "path string, is_dir boolean")
    none = spark.createDataFrame([], "number int, base string, line string")
    assert [(r.rule, r.ignored) for r in ignore.ignored(table, none).collect()] == [(None, False)]
    assert [r.ignored for r in ignore.ignored(table, spark.createDataFrame([(0, None, "**")], "number int, base string, line string")).collect()] == [True]


def located(refs, files):
    out = {}
    for r in set(refs):
        fits = {f for f in files if f == r or f.endswith("/" + r) or r.endswith("/" + f)}
        out[r] = r if r in fits else next(iter(fits)) if len(fits) == 1 else None
    return out


def test_reported_paths_are_those_of_comparing_all(spark):
    rng = random.Random(9)
    path = lambda: "/".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    files, refs = [path() for _ in range(25)] + ["", "x//y"], [path() for _ in range(60)] + ["", "/a", "z/a/b"]
    got = graph.locate_reported(spark.createDataFrame([(r,) for r in refs], "ref string"), spark.createDataFrame([(f,) for f in files], "path string"))
    assert {r.ref: r.path for r in got.collect()} == located(refs, set(files))


def test_one_name_for_all_files_makes_no_square(spark):
    files = spark.range(20_000).select(F.concat(F.lit("d"), "id", F.lit("/index.ts")).alias("path"))
    refs = spark.range(20_000).select(F.concat(F.lit("/root/d"), "id", F.lit("/index.ts")).alias("ref")).unionByName(spark.createDataFrame([("index.ts",)], "ref string"))
    got = graph.locate_reported(refs, files)
    assert got.where("path is not null").count() == 20_000 and got.where("ref = 'index.ts' and path is null").count() == 1


def test_links_are_followed_to_their_end(spark):
    rng = random.Random(2)
    links = [(rng.randrange(40), rng.randrange(45), rng.randrange(3)) for _ in range(60)] + [(50, 50, 0)]
    first = {s: min((p, d) for t, d, p in links if t == s)[1] for s, _, _ in links}
    want = {}
    for start in range(55):
        node, passed, cycle = start, [start], False
        while node in first and not cycle and len(passed) <= 6:
            node = first[node]
            cycle = node in passed
            passed.append(node)
        want[start] = (node, len(passed) - 1, cycle)
    got = graph.follow(spark.createDataFrame(links, "src int, dst int, place int"), spark.range(55).selectExpr("cast(id as int) as node"), 6)
    assert {r.start: (r.node, r.hops, r.cycle) for r in got.collect()} == want


def test_following_knows_no_limit_of_rows(spark):
    """All walks together have more rows than a recursive query may give."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", 100)
    try:
        links = spark.range(100).selectExpr("id as src", "id + 1 as dst", "0 as place")
        got = graph.follow(links, spark.range(100).selectExpr("id as node"), 12)
        assert {(r.start, r.node, r.hops, r.cycle) for r in got.collect()} == {(i, min(i + 12, 100), min(12, 100 - i), False) for i in range(100)}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def saved(spark, at, rows, mode="append", **options):
    table = spark.createDataFrame([(i, f"t{i}", [p], None, c) for i, p, c in rows], notes.SCHEMA).repartition(3)
    table.write.format("notes").options(**options).mode(mode).save(at)


def loaded(spark, at):
    return sorted((r.id, r.created_at) for r in spark.read.format("notes").load(at).collect())


def test_notes_sink(spark):
    spark.dataSource.register(notes.Notes)
    at = fresh(spark, "notes")
    assert loaded(spark, at) == []
    saved(spark, at, [(f"n{i}", "a", f"{i:04d}") for i in range(40)], most=25)
    assert loaded(spark, at) == [(f"n{i}", f"{i:04d}") for i in range(15, 40)]
    saved(spark, at, [("n20", "b", "9999"), ("m", "c", "0000")], most=25)
    assert loaded(spark, at) == sorted([(f"n{i}", f"{i:04d}") for i in range(15, 40) if i != 20] + [("n20", "9999")])
    saved(spark, at, [("x", "b", None)], mode="overwrite")
    assert loaded(spark, at) == [("x", None)] and os.listdir(at.removeprefix("file:")) == ["notes.json"]


def test_a_failed_task_leaves_what_was_there(spark):
    spark.dataSource.register(notes.Notes)
    at = fresh(spark, "notes")
    saved(spark, at, [("a", "p", "1")])
    fails = F.udf(lambda x: 1 // 0 if x == 7 else str(x))
    broken = spark.range(20, numPartitions=4).select(fails("id").alias("id"), F.lit("t").alias("text"), F.array(F.lit("p")).alias("paths"), F.array(F.lit("t")).alias("tags"), F.lit("2").alias("created_at"))
    with pytest.raises(Exception, match="ZeroDivision"):
        broken.write.format("notes").mode("append").save(at)
    assert loaded(spark, at) == [("a", "1")] and os.listdir(at.removeprefix("file:")) == ["notes.json"]


@pytest.mark.parametrize("damage", ["", "{", "[1]", json.dumps({"a": 1}), "\x00"])
def test_a_damaged_file_counts_as_empty(spark, damage):
    spark.dataSource.register(notes.Notes)
    at = fresh(spark, "notes")
    saved(spark, at, [("a", "p", "1")])
    with open(f"{at.removeprefix('file:')}/notes.json", "w") as f:
        f.write(damage)
    assert loaded(spark, at) == []
    saved(spark, at, [("b", "p", "2")])
    assert loaded(spark, at) == [("b", "2")]
