"""The structural queries over a small tree, log, diff and notes of our own. What each must return is written down in
tree_answers.py, row by row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlens.operators import answers, logs, parse
from loomlens.plans import tools
from tree_answers import ANSWERS

TREE = {
    ".gitignore": "dist/\n",
    "package.json": '{"name": "garden", "scripts": {"test": "run", "lint:css": "run", "bad name": "run"}}\n',
    "Makefile": "all: seeds\nseeds:\n\techo\nX := 1\n",
    "README.md": "# Garden\n\nText.\n\n## Beds\n\n```\n# not a heading\n```\n\n### Soil\n\n## Tools\n",
    "packages/core/package.json": '{"name": "@garden/core"}\n',
    "packages/core/src/index.ts": 'export { Bed, plant as sow } from "./bed.js";\nexport * from "./soil";\n',
    "packages/core/src/bed.ts": '''import { Soil, type Grain as Sand } from "./soil";
import fs from "node:fs";

/**
 * A bed of plants.
 * @internal
 */
export class Bed extends Soil {
  private rows = 0;

  constructor(readonly name: string) {
    super();
  }

  /** Puts a plant in. */
  async put(
    plant: string,
    depth = 3,
  ): Promise<void> {
    const hidden = () => depth;
    if (plant === "}") {
      this.rows += hidden();
    }
  }

  #water() {}
}

export const plant = async (name: string) => {
  // class Not {}
  return new Bed(name);
};
const LIMIT = [1, 2];
const pattern = /class [Nope] {/g, text = `function ${plant("x")} no() {`;
export type Row = { id: number };
export { LIMIT as limit };
''',
    "packages/core/src/soil.ts": "export interface Grain {\n  size: number;\n}\nexport abstract class Soil {}\nexport enum Kind { Loam, Clay }\n",
    "packages/web/package.json": '{"name": "web"}\n',
    "packages/web/src/page.tsx": 'import { Bed } from "../../core/src/index";\nimport React from "react";\nexport default function Page() {\n  const bed = new Bed("herbs");\n  bed.put("basil");\n  return null;\n}\n',
    "packages/web/tests/page.test.tsx": 'import Page from "../src/page";\nPage();\n',
    "jobs/run.py": 'import os, jobs.store as st\nfrom .store import Shelf, shelf_of as of\n\n\nclass Job(Shelf):\n    """class Hidden: pass"""\n\n    LIMIT = 3\n\n    def start(self):\n        def inner():\n            return 1\n\n        return inner\n\n    @property\n    def _secret(self):\n        return "def no(): pass"\n\n\nasync def main(argv):\n    # def nothing(): pass\n    return Job()\n\n\nRETRIES = 4\n',
    "jobs/store.py": "class Shelf:\n    pass\n\n\ndef shelf_of(x): return x\n",
    "srv/main.go": 'package main\n\nimport (\n\t"fmt"\n\tlog "garden.test/log"\n)\n\n// Server serves.\ntype Server struct {\n\tport int\n}\n\nfunc (s *Server) Start() error {\n\tfmt.Println("func Not() {")\n\treturn nil\n}\n\nfunc helper() {}\n\nconst Max = 3\n',
    "lib/src/lib.rs": "mod bed;\nuse crate::bed::{Row, deep::Thing as T};\nuse std::io;\n\npub trait Grow {\n    fn grow(&self);\n}\n\npub struct Plot<'a> { name: &'a str }\n\nimpl<'a> Grow for Plot<'a> {\n    fn grow(&self) {\n        let s = \"fn no() {\";\n    }\n}\n",
    "lib/src/bed.rs": "pub struct Row;\n\npub mod deep {\n    pub struct Thing;\n}\n",
    "java/org/garden/App.java": "package org.garden;\n\nimport org.garden.util.Names;\nimport java.util.List;\n\npublic class App {\n  /** Runs. */\n  public static List<String> run(int n) {\n    return Names.of(n);\n  }\n\n  private int hidden(int n) {\n    return n;\n  }\n}\n",
    "java/org/garden/util/Names.java": "package org.garden.util;\n\npublic interface Names {\n}\n",
    "db/schema.sql": "-- Beds.\nCREATE TABLE IF NOT EXISTS beds (\n  id INT, -- CREATE TABLE no (\n  name TEXT\n);\n\ncreate or replace view rows as\nselect 1;\n",
    "conf/app.yaml": "name: garden\n# note: no\nbeds:\n  deep: 1\nend: 2\n",
    "conf/app.toml": "[beds]\nid = 1\n\n[[rows]]\nid = 2\n",
    "bin/run.sh": "source ./env.sh\n\nstart() {\n  echo '}'\n}\n\nfunction stop {\n  :\n}\n",
    "blob.bin": None,
}
LOG = """src/a.ts(3,7): error TS2322: Type mismatch.
packages/web/src/page.tsx:4:9 - error TS2304: Cannot find name 'Bed'.
/work/c.js
  1:10  warning  Unused thing  no-unused-vars
  2:1  error  Parsing error: no rule

error[E0382]: borrow of moved value
   |
 --> lib/src/lib.rs:13:9
warning: unused import
Traceback (most recent call last):
  File "jobs/run.py", line 21, in main
  File "/usr/lib/python3/site-packages/y.py", line 9, in g
ValueError: bad
FAILED tests/t.py::test_a - assert 1 == 2
FAILED tests/u.py
tests/v.py:8: AssertionError: no
  ● sum adds
    at node (/x/node_modules/a.js:1:1)
    at Object.<anonymous> (packages/web/tests/page.test.tsx:2:1)
 ✕ lonely
  ● Console
./srv/main.go:14:2: undefined: fmt
    --- FAIL: TestBeds (0.00s)
[ERROR] /w/App.java:[5,6] cannot find symbol
foo.c:1:2: warning: odd
foo.c:1:2: note[N1]: here
x FATAL: out of memory
packages/web/src/page.tsx:4:9: error: Cannot find name 'Bed'.
nothing here 12:30:10"""
DIFF = """diff --git a/packages/core/src/bed.ts b/packages/core/src/bed.ts
index 1..2 100644
--- a/packages/core/src/bed.ts
+++ b/packages/core/src/bed.ts
@@ -21,0 +22 @@ async put(
+      let more = 1;
@@ -31 +32 @@
-  return null;
+  return new Bed(name);
diff --git a/jobs/store.py b/jobs/store.py
deleted file mode 100644
--- a/jobs/store.py
+++ /dev/null
@@ -1,5 +0,0 @@
-class Shelf:
-    pass
diff --git a/srv/main.go b/srv/main.go
new file mode 100644
--- /dev/null
+++ b/srv/main.go
@@ -0,0 +1,20 @@
+package main
diff --git a/lib/src/old.rs b/lib/src/bed.rs
rename from lib/src/old.rs
rename to lib/src/bed.rs"""
STATUS = "?? conf/app.yaml\n M jobs/run.py\n?? srv/main.go\n?? "
BRANCHES = "feature\n  develop\n  master\norigin/develop"
NOTES = [
    ("n1", "Beds need Water", ["packages/core/src/bed.ts"], ["tip"], "2024-01-01"),
    ("n2", "the job retries", ["jobs/run.py", "jobs/store.py"], ["todo"], "2024-03-01"),
    ("n3", "water the beds", [], [], "2024-02-01"),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_indexes: dict[str, tools.Index] = {}


class Given:
    """The fixture as tables of a session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.files = spark.createDataFrame([(p, len(c or ""), 0, c) for p, c in TREE.items()], "path string, size long, mtime_ms long, content string")
        self.log, self.diff, self.status, self.branches = (self.text(x) for x in (LOG, DIFF, STATUS, BRANCHES))
        self.notes = spark.createDataFrame(NOTES, "id string, text string, paths array<string>, tags array<string>, created_at string")

    def text(self, x: str) -> DataFrame:
        return self.spark.createDataFrame([(0, i, line) for i, line in enumerate(x.split("\n"))], "log_id int, line_no int, text string")

    @property
    def ix(self) -> tools.Index:
        key = self.spark.sparkContext.applicationId
        if key not in _indexes:
            _indexes[key] = tools.Index(self.files)
        return _indexes[key]


def _literal(x, kind: str) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if kind == "VARCHAR" else str(x)


def values(columns: dict[str, str], rows: list[tuple]) -> str:
    """SQL for rows as they are; without any, for none."""
    typed = ", ".join(f"c{i}::{kind} AS {name}" for i, (name, kind) in enumerate(columns.items()))
    names = ", ".join(f"c{i}" for i in range(len(columns)))
    body = ", ".join("(" + ", ".join(_literal(x, k) for x, k in zip(r, columns.values(), strict=True)) + ")" for r in rows)
    return f"SELECT {typed} FROM (VALUES {body or '(' + ', '.join(['NULL'] * len(columns)) + ')'}) t({names})" + ("" if rows else " WHERE false")


def plainly(df: DataFrame) -> DataFrame:
    """df with whole numbers as long, fractions rounded, and lists joined by commas."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        c = F.array_join(c, ",") if kind.startswith("array") else F.round(c, 6) if kind == "double" else c.cast("long") if kind in ("int", "bigint") else c
        out.append(c.alias(name))
    return df.select(*out)


def asked(f: Callable[[Given], DataFrame]) -> Callable:
    name = f"tree_{f.__name__}"
    QUERIES[name] = lambda spark, sf_dir: plainly(f(Given(spark)))
    if name in ANSWERS:
        ORACLES[name] = values(*ANSWERS[name])
    return f


@asked
def symbols(g):
    return g.ix.symbols.select("path", "name", "kind", "start_line", "end_line", "depth", "exported", "doc", "signature")


@asked
def imports(g):
    return g.ix.parsed.select("path", F.inline("imports"))


@asked
def files(g):
    return g.ix.parsed.select("path", "language", "line_count", "exports")


@asked
def masked(g):
    lines = [(p, i, x) for p in ("packages/core/src/bed.ts", "jobs/run.py", "db/schema.sql") for i, x in enumerate(parse.mask_source(TREE[p], parse.detect_language(p)).split("\n"), 1)]
    return g.spark.createDataFrame(lines, "path string, line int, text string").where("trim(text) <> ''").select("path", "line", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), F.length("text").alias("width"))


@asked
def edges(g):
    return g.ix.edges


@asked
def externals(g):
    return g.ix.externals


@asked
def owners(g):
    return g.ix.owners


@asked
def diagnostics(g):
    return logs.ranked(logs.diagnostics(g.log)).select("place", "severity", "file", "line", "col", "code", "message", "source")


@asked
def diff(g):
    c = logs.changes(g.diff)
    return c.select("path", "status", "previous", F.transform("ranges", lambda r: F.concat(r["from"].cast("string"), F.lit("-"), r["to"].cast("string"))).alias("ranges"), "added", "removed")


@asked
def untracked(g):
    return logs.untracked(g.status, logs.changes(g.diff)).select("path", "status")


@asked
def default_base(g):
    return logs.default_base(g.branches).select("base")


@asked
def log_tail(g):
    return logs.tail(g.log, 3, 20).select("line_no", "text")


@asked
def map_folders(g):
    return tools.map_folders(g.ix).select("folder", "path", "language", "line_count", "n_in", "n_out", "score", F.row_number().over(tools.Window.orderBy(F.desc("best"), "folder", F.desc("score"), "path")).alias("place"))


@asked
def map_focus(g):
    return tools.map_files(g.ix, "packages", focus="plant").select("path", "score")


@asked
def map_tree(g):
    return tools.map_tree(g.ix)


@asked
def tally(g):
    return tools.tally(g.ix)


@asked
def outline(g):
    return tools.outline(g.ix, "packages/core/src/bed.ts", include_private=False).select("name", "depth", "handle")


@asked
def outline_lines(g):
    return tools.outline_lines(g.ix, "packages/core/src", 300)


@asked
def search(g):
    return tools.search(g.ix, "plant bed").select("path", "line", "text", "symbol", "score", F.round("rank", 4).alias("rank"))


@asked
def search_context(g):
    hits = tools.search(g.ix, "basil")
    return tools.search_context(g.ix, hits, 1)


@asked
def search_counts(g):
    return tools.search_counts(tools.search(g.ix, "plant bed"))


@asked
def search_symbols(g):
    return tools.search_symbols(g.ix, "bed").select("path", "name", "score")


@asked
def search_regex(g):
    return tools.search_regex(g.ix, r"new \w+\(").select("path", "line", "text")


@asked
def read_lines(g):
    return tools.read(g.ix, "jobs/run.py", 5, 5, context=1)


@asked
def read_symbol(g):
    return tools.read_symbol(g.ix, "packages/core/src/bed.ts", "bed.put")


@asked
def read_handle(g):
    return tools.read_handle(g.ix, "r" + hashlib.sha1(b"jobs/store.py:5:5:function").hexdigest()[:8], 1)


@asked
def skeleton(g):
    return tools.skeleton(g.ix, "packages/core/src/bed.ts")


@asked
def define(g):
    return tools.define(g.ix, "Bed", "packages/web/src/page.tsx").select("path", "name", "start_line", "via")


@asked
def define_local(g):
    return tools.define(g.ix, "helper", "srv/main.go").select("path", "name", "via")


@asked
def trace(g):
    return tools.trace(g.ix, "packages/core/src/soil.ts", depth=4)


@asked
def trace_dependencies(g):
    return tools.trace(g.ix, "lib/src/lib.rs", "dependencies")


@asked
def references(g):
    return tools.references(g.ix, "packages/core/src/index.ts", "Bed").select("path", "line", "text")


@asked
def locate(g):
    return tools.locate(g.ix, "grow").unionByName(tools.locate(g.ix, "jobs/run.py"))


@asked
def changes(g):
    return tools.changes(g.ix, g.diff, g.status)


@asked
def still_imported(g):
    return tools.still_imported(g.ix, logs.changes(g.diff))


@asked
def churn(g):
    return tools.churn(logs.changes(g.diff))


@asked
def diagnose(g):
    return tools.diagnose(g.ix, g.log, warnings=True, most=100)


@asked
def problem_windows(g):
    return tools.problem_windows(g.ix, tools.diagnose(g.ix, g.log), 1)


@asked
def problems_by_file(g):
    return tools.by_file(tools.diagnose(g.ix, g.log, warnings=True))


@asked
def notes(g):
    more = tools.add_note(tools.remove_note(g.notes, "n2"), "n4", " Water at noon ", ["conf/app.yaml"], [], "2024-04-01")
    return tools.notes(more, "water").select("id", "text", "score")


@asked
def notes_on(g):
    return tools.notes_on(g.notes, ["jobs/store.py"]).select("id", "paths")


@asked
def health(g):
    return tools.health(g.ix)


@asked
def checks(g):
    return tools.checks(g.files)


@asked
def path_kinds(g):
    return tools.path_kinds(g.ix, g.spark.createDataFrame([(p,) for p in ("jobs", "jobs/run.py", "nowhere", "")], "path string"))


@asked
def answer(g):
    rows = tools.search_regex(g.ix, r"Bed").select("path", "line", F.concat_ws("  ", answers.span(F.col("path"), F.col("line"), F.col("line")), F.trim("text")).alias("row"))
    return answers.answer(rows, "row", ["path", "line"], 100, "search — Bed", "read a file")


@asked
def incremental(g):
    """References after four batches: an edit, a new file that an import waited for, a deletion, and a lost track."""
    from loomlens.streaming import incremental as inc

    tree = dict(TREE)
    listing = lambda n: g.spark.createDataFrame([(p, len(c or ""), n if c != TREE.get(p) else 0, c) for p, c in tree.items()], "path string, size long, mtime_ms long, content string")
    state = inc.build(listing(0))
    for n, (paths, edit) in enumerate([(["jobs/store.py"], {"jobs/store.py": "from . import run\n"}), (["jobs/late.py", "jobs/run.py"], {"jobs/run.py": "from .late import x\n", "jobs/late.py": "x = 1\n"}), (["lib/src/bed.rs"], {"lib/src/bed.rs": ""}), (None, {"srv/main.go": "package main\n"})], 1):
        tree.update(edit)
        if "lib/src/bed.rs" in edit:
            del tree["lib/src/bed.rs"]
        state = inc.apply(state, listing(n), paths)
    whole = inc.build(listing(4))
    apart = [x.exceptAll(y).count() + y.exceptAll(x).count() for x, y in ((state.files, whole.files), (state.parsed.drop("symbols", "imports"), whole.parsed.drop("symbols", "imports")), (state.resolved, whole.resolved))]
    return state.resolved.where("dst is not null").select("src", "ref", "dst", F.lit(sum(apart)).alias("unlike_rebuild"))
