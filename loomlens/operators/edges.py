"""Edges and their importance as a maintained view over references that resolve to the first candidate that exists.

Every candidate path has the references that wait for it, whether it exists or not. So when files come or go, what waits
for them is looked up and only those sources are resolved again; what their edges gain and lose is written as +1 and -1
rows, of which degrees are sums. All tables are appended to by batches and are in order of the key they are looked up by;
they are folded into one when what was appended outgrows what was there. A batch that is run again changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlens.sources.shared import written
from loomlens.sources.versions import Versions

from . import graph

#: Keys up to which a lookup is pushed to the scan, and rows of a file, about.
FEW, FILE_ROWS = 1000, 1 << 20
#: Of each table its columns and what it is looked up by.
TABLES = {
    "files": ("path string, sign int", "path"),
    "waits": ("path string, src string", "path"),
    "refs": ("src string, batch long, ref string, prio int, path string", "src"),
    "edges": ("src string, dst string, sign int", "src"),
}


class Edges:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.versions = spark, folder.rstrip("/"), Versions(spark, folder)

    def manifest(self) -> dict:
        return self.versions.last() or {"version": 0, "batch": None, "tables": {k: [] for k in TABLES}}

    def _table(self, m: dict, kind: str, since: int = 0) -> DataFrame:
        schema, _ = TABLES[kind]
        names = [f"{self.folder}/{kind}/{x['name']}" for x in m["tables"][kind][since:] if x["rows"]]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def _put(self, m: dict, df: DataFrame, kind: str, name: str, stored: bool = False) -> int:
        """Appends rows to a table, each once in `waits`, whose equal rows meet in the ranges that they are dealt to.
        What is worked out to get them is written first, as it is counted and looked at for bounds; rows that are only
        read from stored ones are not."""
        schema, key = TABLES[kind]
        rows = df.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]})" for c in schema.split(", ")])
        rows = rows if stored else written(rows, kind)
        n = rows.count()
        if n:
            path = f"{self.folder}/{kind}/{name}"
            dealt = rows.repartitionByRange(max(1, -(-n // FILE_ROWS)), *rows.columns)
            (dealt.distinct() if kind == "waits" else dealt).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
            n = self.spark.read.schema(schema).parquet(path).count() if kind == "waits" else n
        m["tables"][kind].append({"name": name, "rows": n})
        return n

    def _of(self, table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
        """Rows of a table whose key is wanted (one column of that name): few keys reach the scan as values."""
        few = [r[0] for r in wanted.limit(FEW + 1).collect()]
        return table.where(F.col(key).isin(*few)) if len(few) <= FEW else table.join(wanted, key, "left_semi")

    def apply(self, batch: int, added: DataFrame | None = None, gone: DataFrame | None = None, refs: DataFrame | None = None) -> dict | None:
        """Folds in a batch: files (path) that came or went, and references (src, ref, candidates) that replace all those
        of their sources; a source that refers to nothing any more has one row with null candidates. Gives how many files
        moved, references were resolved and edges written; None if the batch is in already."""
        m = self.manifest()
        if m["batch"] is not None and batch <= m["batch"]:
            return None
        name = f"{batch:06d}-{uuid.uuid4().hex[:8]}"
        none = self.spark.createDataFrame([], "path string")
        moves = (added if added is not None else none).select(F.col("path").cast("string").alias("path"), F.lit(1).alias("want"))
        moves = written(moves.unionByName((gone if gone is not None else none).select(F.col("path").cast("string").alias("path"), F.lit(0).alias("want"))).groupBy("path").agg(F.max("want").alias("want")), "moves")
        there = self._of(self._table(m, "files"), "path", moves.select("path")).groupBy("path").agg(F.sum("sign").alias("have"))
        signs = moves.join(there, "path", "left").select("path", (F.col("want") - F.coalesce("have", F.lit(0))).alias("sign")).where("sign <> 0")
        n_moved = self._put(m, signs, "files", name)
        moved = self._table({"tables": {"files": m["tables"]["files"][-1:]}}, "files").select("path")

        changed = self.spark.createDataFrame([], "src string, ref string, candidates array<string>") if refs is None else refs
        changed = changed.select(F.col("src").cast("string").alias("src"), F.col("ref").cast("string").alias("ref"), F.col("candidates").cast("array<string>").alias("candidates"))
        new = written(changed.select("src", "ref", F.posexplode_outer("candidates").alias("prio", "path")), "new")
        known = self._table(m, "refs")
        waiting = self._of(self._table(m, "waits"), "path", moved).select("src")
        sources = written(waiting.unionByName(new.select("src")).distinct(), "sources")
        # Of a source's references those of its last batch count.
        mine = self._of(known, "src", sources).join(new.select("src").distinct(), "src", "left_anti")
        mine = mine.withColumn("last", F.max("batch").over(Window.partitionBy("src"))).where("batch = last")
        mine = mine.select("src", "ref", "prio", "path").unionByName(new)
        mine = written(mine.where("path is not null"), "mine")
        self._put(m, new.withColumn("batch", F.lit(batch)), "refs", name, stored=True)
        self._put(m, new.where("path is not null").select("path", "src"), "waits", name, stored=True)

        files = self._of(self._table(m, "files"), "path", mine.select("path").distinct()).groupBy("path").agg(F.sum("sign").alias("have")).where("have > 0")
        dst = mine.join(files, "path").groupBy("src", "ref").agg(F.min_by("path", "prio").alias("dst"))
        # What is there now and the signed rows of before meet once.
        now = dst.where("src <> dst").select("src", "dst", F.lit(1).alias("now"), F.lit(0).alias("sign"))
        before = self._of(self._table(m, "edges"), "src", sources).select("src", "dst", F.lit(0).alias("now"), "sign")
        change = now.unionByName(before).groupBy("src", "dst").agg((F.max("now") - (F.sum("sign") > 0).cast("int")).alias("sign")).where("sign <> 0")
        n_edges = self._put(m, change, "edges", name)
        report = {"moved": n_moved, "sources": sources.count(), "references": mine.select("src", "ref").distinct().count(), "edges": n_edges}
        m |= {"version": m["version"] + 1, "batch": batch}
        self._fold(m)
        self.versions.commit(m)
        return report

    def _fold(self, m: dict) -> None:
        """Folds each table into one where appended rows outnumber those of the first, so that each row is rewritten a
        bounded number of times on the average."""
        for kind, parts in m["tables"].items():
            if len(parts) < 3 or sum(p["rows"] for p in parts[1:]) <= parts[0]["rows"]:
                continue
            rows = self._table(m, kind)
            if kind == "files":
                rows = rows.groupBy("path").agg(F.sum("sign").alias("sign")).where("sign <> 0")
            elif kind == "edges":
                rows = rows.groupBy("src", "dst").agg(F.sum("sign").alias("sign")).where("sign <> 0")
            elif kind == "refs":
                rows = rows.join(rows.groupBy("src").agg(F.max("batch").alias("batch")), ["src", "batch"])
            folded: dict = {"tables": {kind: []}}
            self._put(folded, rows, kind, f"{m['version']:06d}-{uuid.uuid4().hex[:8]}", stored=kind == "waits")
            m["tables"][kind] = folded["tables"][kind]

    def edges(self) -> DataFrame:
        """(src, dst), distinct, without loops."""
        return self._table(self.manifest(), "edges").groupBy("src", "dst").agg(F.sum("sign").alias("n")).where("n > 0").select("src", "dst")

    def importance(self) -> DataFrame:
        """(node, n_in, n_out, score): sums of the signed rows, without the edges themselves."""
        rows = self._table(self.manifest(), "edges")
        ends = rows.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.col("sign").alias("o")).unionByName(rows.select(F.col("dst").alias("node"), F.col("sign").alias("i"), F.lit(0).alias("o")))
        n = ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out")).where("n_in > 0 or n_out > 0")
        return n.withColumn("score", graph.score(F.col("n_in"), F.col("n_out")))
