"""Every query against its SQL, the structural queries on a small tree of our own, and logs and diffs on fixtures."""

import os

import duckdb
import pytest
import tree_fixture

from loomlens.operators import logs
from loomlens.plans import catalogue

QUERIES, ORACLES = catalogue.QUERIES | tree_fixture.QUERIES, catalogue.ORACLES | tree_fixture.ORACLES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(columns, rows):
    out = [tuple(None if x is None or x != x else round(x, 6) if isinstance(x, float) else x for x in r) for r in rows]
    return sorted(([r[i] for i in sorted(range(len(columns)), key=columns.__getitem__)] for r in out), key=str)


def test_only_the_parse_of_prose_has_no_sql(spark):
    """mask_source reads every text as source: a row each, with as many lines as the text has."""
    assert set(QUERIES) - set(ORACLES) == {"mask_source"}
    got = {r.path: r.line_count for r in QUERIES["mask_source"](spark, SF).collect()}
    texts = {f"{r.doc_id}.ts": r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got == {p: x.count("\n") + (x != "" and not x.endswith("\n")) for p, x in texts.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, SF)
    want = sql.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.columns, [tuple(r) for r in got.collect()]) == plain(want.columns, want.fetchall())


def table(spark, *texts):
    return spark.createDataFrame([(k, i, line) for k, text in enumerate(texts) for i, line in enumerate(text.split("\n"))], "log_id int, line_no int, text string")


def test_diagnostics(spark):
    log = """src/a.ts(3,7): error TS2322: Type mismatch.
src/b.ts:4:2 - error TS2304: Cannot find name.
/work/c.js
  1:10  warning  Unused thing  no-unused-vars
error[E0382]: borrow of moved value
 --> src/main.rs:5:9
Traceback (most recent call last):
  File "app/x.py", line 12, in f
  File "/usr/lib/python3/site-packages/y.py", line 9, in g
ValueError: bad
FAILED tests/t.py::test_a - assert 1 == 2
  ● sum adds
    at Object.<anonymous> (src/sum.test.ts:8:3)
main.go:3:2: undefined: y
[ERROR] /w/A.java:[5,6] cannot find symbol
foo.c:1:2: warning: odd
nothing here"""
    got = [(r.source, r.severity, r.file, r.line, r.col, r.code) for r in logs.ranked(logs.diagnostics(table(spark, log))).orderBy("place").collect()]
    assert set(got) == {("tsc", "error", "src/a.ts", 3, 7, "TS2322"), ("tsc", "error", "src/b.ts", 4, 2, "TS2304"), ("eslint", "warning", "/work/c.js", 1, 10, "no-unused-vars"), ("cargo", "error", "src/main.rs", 5, 9, "E0382"), ("python", "error", "app/x.py", 12, None, "ValueError"), ("pytest", "error", "tests/t.py", None, None, "test_a"), ("jest", "error", "src/sum.test.ts", 8, 3, None), ("go", "error", "main.go", 3, 2, None), ("maven", "error", "/w/A.java", 5, 6, None), ("generic", "warning", "foo.c", 1, 2, None)}
    assert [x[1] for x in got] == ["error"] * 8 + ["warning"] * 2
    assert logs.diagnostics(table(spark, "all is well")).collect() == []


def most_code(spark, df):
    """Bytes of the longest generated method of a query."""
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$")
    found = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(found.apply(i)._3().maxMethodCodeSize() for i in range(found.size()))


def test_forms_are_small_enough_to_compile(spark):
    """HotSpot leaves methods of over 8,000 bytes uncompiled, which made each line cost many times as much."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = logs.diagnostics(table(spark, "Traceback\n  File \"a.py\", line 2, in f\nKeyError: x\nTraceback\nValueError: y"))
        assert 0 < most_code(spark, found) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # A frame counts for its own traceback only.
    assert {(r.code, r.file, r.line) for r in found.collect()} == {("KeyError", "a.py", 2), ("ValueError", None, None)}


def test_changes(spark):
    diff = """diff --git a/x.ts b/x.ts
--- a/x.ts
+++ b/x.ts
@@ -1 +1,2 @@
-old
+new
+two
@@ -9,2 +10,0 @@
-gone
-gone
diff --git a/n.ts b/n.ts
--- /dev/null
+++ b/n.ts
@@ -0,0 +1 @@
+x
diff --git a/d.ts b/d.ts
--- a/d.ts
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git a/p.ts b/q.ts
rename from p.ts"""
    got = {r.path: (r.status, r.previous, [tuple(x) for x in r.ranges], r.added, r.removed) for r in logs.changes(table(spark, diff)).collect()}
    assert got == {"x.ts": ("modified", None, [(1, 2), (10, 10)], 2, 3), "n.ts": ("added", None, [(1, 1)], 1, 0), "d.ts": ("deleted", None, [(1, 1)], 0, 1), "q.ts": ("renamed", "p.ts", [], 0, 0)}


def test_diffs_move_once(spark):
    """Lines of a log are dealt while they are few rows, a range is worked out once, and what is no mark stays behind."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES["diff_changes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 1 and plan.count("split(substring_index") == 1
    lines = table(spark, "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n same\n--- it\n-\n++++\n+++ new\n\\\\ No newline")
    assert logs._marked(lines).where("text is not null").count() == 6
    got = [(r.path, r.status, r.added, r.removed, [tuple(x) for x in r.ranges]) for r in logs.changes(lines).collect()]
    assert got == [("x", "modified", 1, 1, [(1, 2)])]


def test_clamping_works_a_text_out_once(spark):
    """However long the text, only a beginning is tried, and what the text is made of stands in the plan once."""
    from pyspark.sql import functions as F

    from loomlens.operators import answers

    rows = spark.createDataFrame([(None,), ("",), ("ab c\n" * 20_000,), ("x" * 48,)], "x string")
    rows = rows.select(answers.clamp_tokens(F.translate("x", "\n", " "), 12).alias("label"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    got = [r.label for r in rows.collect()]
    assert got[:2] == [None, ""] and got[2].startswith("ab c ab c") and got[2].endswith("…") and len(got[2]) <= 48 and got[3] == "x" * 48
