"""Headings and their extents against plain loops, odd headings, and a page with very many."""

import random

from loomlens.operators import outline, parse


def lines(spark, text):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"), 1)], "k int, line_no int, line string")


def test_extents_are_those_of_a_loop(spark):
    rng = random.Random(2)
    rows = [(k, n, rng.randrange(6)) for k in range(30) for n in sorted(rng.sample(range(1, 60), rng.randrange(1, 25)))]
    got = {(r.k, r.start): r.stop for r in outline.extents(spark.createDataFrame(rows[::-1], "k int, start int, depth int"), "k").collect()}
    for k, n, d in rows:
        follows = [m - 1 for j, m, e in rows if j == k and m > n and e <= d]
        assert got[k, n] == (min(follows) if follows else max(m for j, m, _ in rows if j == k))


def test_extents_of_a_hundred_thousand_headings(spark):
    many = spark.range(100_000).selectExpr("1 as k", "cast(id as int) as start", "cast(id % 6 as int) as depth")
    assert outline.extents(many, "k").selectExpr("sum(stop - start)").first()[0] == sum({0: 5, 1: 4, 2: 3, 3: 2, 4: 1, 5: 0}[i % 6] if i // 6 < 16666 else 99_999 - i if i % 6 else 99_999 - i for i in range(100_000))


ODD = "# One ##\n#Two\n## Three##\n   ### Four\n    # Five\n```\n# Six\n```\n#\n####### Seven\n# #\n## \tEight \t# \n~~~\n## Nine"


def test_markdown_by_the_rule(spark):
    want = [(1, 0, "One"), (3, 1, "Three##"), (4, 2, "Four"), (9, 0, ""), (11, 0, ""), (12, 1, "Eight")]
    got = outline.markdown_headings(lines(spark, ODD), "k").orderBy("start").collect()
    assert [(r.start, r.depth, r.name) for r in got] == want
    assert [(s.start_line, s.depth, s.name) for s in parse.extract_symbols(ODD, "markdown")] == want
    ends = outline.extents(outline.markdown_headings(lines(spark, ODD), "k"), "k").orderBy("start").collect()
    assert [r.stop for r in ends] == [8, 8, 8, 10, 12, 12]
    assert [s.end_line for s in parse.extract_symbols(ODD, "markdown")] == [8, 8, 8, 10, 14, 14]


def test_keys_and_flat_extents(spark):
    text = "a: 1\n  b: 2\n# c: 3\n[part.x]\nd-e : 4\n- f\n"
    keys = outline.flat_extents(outline.config_keys(lines(spark, text), "k"), "k").orderBy("start").collect()
    assert [(r.name, r.start, r.stop) for r in keys] == [("a", 1, 3), ("part.x", 4, 4), ("d-e", 5, 5)]


def test_empty(spark):
    assert outline.extents(outline.markdown_headings(lines(spark, ""), "k"), "k").collect() == []
