"""The structural queries on a small tree of our own."""

import pytest

from loomlens.plans import tools

TREE = {
    "package.json": '{"name": "root"}',
    "packages/core/package.json": '{"name": "core"}',
    "packages/web/package.json": '{"name": "web"}',
    "packages/core/src/index.ts": 'export { Store } from "./store.js";\n',
    "packages/core/src/store.ts": "/** Keeps rows. */\nexport class Store {\n  put(row: string): void {\n    const a = 1;\n    const b = 2;\n    const c = 3;\n    console.log(row);\n  }\n}\n",
    "packages/web/src/page.ts": 'import { Store } from "../../core/src/index";\nimport x from "react";\nexport function page(): void {\n  new Store().put("httpResponse");\n}\n',
    "packages/web/test/page.test.ts": 'import { page } from "../src/page";\npage();\n',
    "tool/run.py": "from .util import helper\n\ndef main():\n    helper()\n",
    "tool/util.py": "def helper():\n    return 1\n",
    "blob.bin": None,
}


@pytest.fixture(scope="module")
def ix(spark):
    return tools.Index(spark.createDataFrame([(p, len(c or ""), 0, c) for p, c in TREE.items()], "path string, size long, mtime_ms long, content string"))


def test_graph_and_trace(ix):
    edges = {(r.src.split("/")[-1], r.dst.split("/")[-1]) for r in ix.edges.collect()}
    assert edges == {("index.ts", "store.ts"), ("page.ts", "index.ts"), ("page.test.ts", "page.ts"), ("run.py", "util.py")}
    got = [(r.path, r.hop, r["class"], r.owner, r.crosses) for r in tools.trace(ix, "packages/core/src/store.ts", depth=4).collect()]
    assert got == [("packages/core/src/index.ts", 1, "entrypoint", "core", False), ("packages/web/src/page.ts", 2, None, "web", True), ("packages/web/test/page.test.ts", 3, "test", "web", True)]
    assert [(r.path, r.line) for r in tools.references(ix, "packages/core/src/index.ts", "Store").collect()] == [("packages/web/src/page.ts", 4)]
    assert [r.path for r in tools.trace(ix, "tool/run.py", "dependencies").collect()] == ["tool/util.py"]


def test_map_outline_read(ix):
    assert tools.map_files(ix, "packages", per_file=3).first().path == "packages/core/src/index.ts"
    assert tools.map_files(ix, focus="helper").first().path in ("tool/run.py", "tool/util.py")
    tree = {r.dir: (r.files, r.lines) for r in tools.map_tree(ix).collect()}
    assert tree["tool"] == (2, 6) and tree["packages"] == (0, 0) and tree["packages/core/src"] == (2, 10)
    assert [(r.name, r.depth) for r in tools.outline(ix, "packages/core/src/store.ts").collect()] == [("Store", 0), ("put", 1)]
    assert [r.line for r in tools.read(ix, "tool/run.py", 3, 3, context=1).collect()] == [2, 3, 4]
    assert [r.line for r in tools.read_symbol(ix, "packages/core/src/store.ts", "store.put").collect()] == [3, 4, 5, 6, 7, 8]
    assert [r.text for r in tools.skeleton(ix, "packages/core/src/store.ts").collect()][3] == "… 4 lines"


def test_search_and_define(ix):
    got = tools.search(ix, "http response").collect()
    assert [(r.path, r.line, r.symbol) for r in got] == [("packages/web/src/page.ts", 4, "page")]
    assert tools.search_symbols(ix, "store").first().name == "Store"
    assert [r.path for r in tools.search_regex(ix, r"new \w+\(").collect()] == ["packages/web/src/page.ts"]
    d = tools.define(ix, "Store", "packages/web/src/page.ts").collect()
    assert [(r.path, r.via) for r in d] == [("packages/core/src/store.ts", "import")]
    assert [(r.path, r.via) for r in tools.define(ix, "helper").collect()] == [("tool/util.py", "global")]


def test_changes_diagnose_notes(spark, ix):
    rows = lambda text: spark.createDataFrame([(0, i, x) for i, x in enumerate(text.split("\n"))], "log_id int, line_no int, text string")
    diff = "diff --git a/packages/core/src/store.ts b/packages/core/src/store.ts\n--- a/packages/core/src/store.ts\n+++ b/packages/core/src/store.ts\n@@ -5 +5 @@\n-a\n+b"
    assert [(r.path, r.symbols, r.dependents, r.added) for r in tools.changes(ix, rows(diff)).collect()] == [("packages/core/src/store.ts", ["put"], 1, 1)]
    got = tools.diagnose(ix, rows("/ci/work/packages/web/src/page.ts:4:3 - error TS1: no\nok")).collect()
    assert [(r.file, r.line, r.symbol) for r in got] == [("packages/web/src/page.ts", 4, "page")]
    table = spark.createDataFrame([("a", "Use the Store", ["x.ts"], ["tip"], "2024-01-01"), ("b", "other", [], [], "2024-01-02")], "id string, text string, paths array<string>, tags array<string>, created_at string")
    assert [r.id for r in tools.notes(table).collect()] == ["b", "a"]
    assert [r.id for r in tools.notes(table, "store").collect()] == ["a"] and [r.id for r in tools.notes(table, path="x.ts").collect()] == ["a"]
    assert {r.label: r.n for r in tools.health(ix).collect()} == {"files": 10, "files not read": 1, "files without symbols": 4, "imports from outside": 1}


def test_traced_externals_and_notes(spark, ix):
    assert [tuple(r) for r in tools.trace_externals(ix, "packages/web/src/page.ts").collect()] == [("packages/web/src/page.ts", "react")]
    assert tools.trace_externals(ix, "packages/web/src/page.ts", 0).collect() == tools.trace_externals(ix, "tool/run.py").collect() == []
    rows = [(f"n{i}", "long " * 40 if i == 4 else "short", ["tool/run.py"] if i else ["other"], [], f"2024-01-0{i + 1}") for i in range(5)]
    table = spark.createDataFrame(rows, "id string, text string, paths array<string>, tags array<string>, created_at string")
    got = [tuple(r) for r in tools.trace_notes(table, "tool/run.py").collect()]
    assert [i for i, _ in got] == ["n4", "n3", "n2"] and len(got[0][1]) == 160 and got[0][1].endswith("…") and got[1][1] == "short"


def test_changes_under_a_prefix(spark, ix):
    text = "".join(f"diff --git a/{p} b/{p}\n--- a/{p}\n+++ b/{p}\n@@ -1 +1 @@\n-a\n+b\n" for p in ("tool/util.py", "tool/run.py", "toolbox.py", "packages/web/src/page.ts"))
    diff = spark.createDataFrame([(0, i, x) for i, x in enumerate(text.split("\n"))], "log_id int, line_no int, text string")
    assert [r.path for r in tools.changes(ix, diff).collect()] == ["packages/web/src/page.ts", "tool/run.py", "tool/util.py", "toolbox.py"]
    assert [r.path for r in tools.changes(ix, diff, prefix="tool").collect()] == ["tool/run.py", "tool/util.py"]


def test_failed_runs_without_problems_keep_their_end(spark, ix):
    text = {0: ["src/a.ts:4:3 - error TS1: no", "end"], 1: ["starting", "", "  ", "killed " + "x" * 300, "exit 9"], 2: ["", " "]}
    log = spark.createDataFrame([(k, i, x) for k, v in text.items() for i, x in enumerate(v)], "log_id int, line_no int, text string")
    got = sorted((r.log_id, r.line_no, r.text) for r in tools.unexplained(log, 2).collect())
    assert [g[:2] for g in got] == [(1, 3), (1, 4)] and got[1][2] == "exit 9" and len(got[0][2]) == 200
    assert len(tools.unexplained(log).collect()) == 3 and tools.unexplained(log.limit(0)).collect() == []
    # An exact path beats files that end in it; a name that several files end in stays as it is reported.
    named = spark.createDataFrame([(0, i, f"{p}:1:1 - error TS{i}: no") for i, p in enumerate(("tool/util.py", "package.json", "x/index.ts"))], "log_id int, line_no int, text string")
    assert [r.file for r in tools.diagnose(ix, named, most=0).collect()] == ["tool/util.py"]
    assert [r.file for r in tools.diagnose(ix, named).collect()] == ["tool/util.py", "package.json", "x/index.ts"]


def test_parse_cache(spark, tmp_path):
    """Rows are read back while path, size and time stay, and only what is asked for."""
    files = lambda rows: spark.createDataFrame(rows, "path string, size long, mtime_ms long, content string")
    first = [("a.py", 5, 1, "X = 1"), ("b.py", 5, 1, "Y = 1")]
    folder = str(tmp_path / "cache")
    names = lambda df: {r.path: [s.name for s in r.symbols] for r in df.collect()}
    assert names(tools.parsed_with_cache(spark, files(first), folder)) == {"a.py": ["X"], "b.py": ["Y"]}
    second = [("a.py", 5, 1, "not read again"), ("b.py", 6, 2, "YZ = 1"), ("c.py", 5, 1, "Z = 1")]
    assert names(tools.parsed_with_cache(spark, files(second), folder)) == {"a.py": ["X"], "b.py": ["YZ"], "c.py": ["Z"]}
    assert names(tools.parsed_with_cache(spark, files(first[:1]), folder)) == {"a.py": ["X"]}


def test_short_forms(spark):
    from pyspark.sql import functions as F

    from loomlens.operators import answers

    row = spark.range(1).select(answers.plural(F.lit(1), "row").alias("a"), answers.plural(F.lit(2), "entry", "entries").alias("b"), answers.fields(F.lit("x"), F.lit(None), F.lit(""), F.lit(3)).alias("c"), answers.indent(F.lit(2), F.lit("x")).alias("d"), answers.span(F.lit("p"), F.lit(3), F.lit(3)).alias("e"), answers.span(F.lit("p"), F.lit(3), F.lit(9)).alias("f")).first()
    assert tuple(row) == ("1 row", "2 entries", "x  3", "    x", "p:3", "p:3-9")
    assert [answers.clamp_budget(x) for x in (None, 5, 300, 99_999)] == [2000, 100, 300, 25_000]
    assert answers.split_command("""run 'a b' "c 'd" e"f g"h  '' \t$X; "open end""") == ["run", "a b", "c 'd", "ef gh", "", "$X;", "open end"]


def test_watch_batches():
    from loomlens.streaming import incremental

    assert incremental.wanted(["a.py", "dist/x.js", "a/node_modules/b.js"]) == ["a.py"]
    assert incremental.wanted(None) is None and incremental.wanted(["x/.gitignore"]) is None and incremental.wanted([f"{i}.py" for i in range(401)]) is None
    assert incremental.wanted([".git/index"]) == []
