"""Edges from references, importance, bounded walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlens.sources.shared import written


def resolve(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(src, ref, dst): for each reference its first candidate that exists; null if none. refs: src, ref, candidates."""
    each = refs.select("src", "ref", F.posexplode("candidates").alias("prio", "path"))
    found = each.join(files.select("path"), "path").groupBy("src", "ref").agg(F.min_by("path", "prio").alias("dst"))
    return refs.select("src", "ref").join(found, ["src", "ref"], "left")


def resolve_ends(refs: DataFrame, files: DataFrame, endings: bool = True) -> DataFrame:
    """(src, ref, path): the one file that a path's end (src, ref, tail) means. Of files with the end's last name those
    count whose path is the end, or ends in it after a slash; where none does and only one file has the name, that one.
    Several leave it open. With `endings` a path also ends as it does without its ending. The join is by the last name, so
    nothing is compared with all files."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    bare = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    met = refs.withColumn("base", last("tail")).join(files.select("path", last("path").alias("base")), "base")
    whole = (F.col("path") == F.col("tail")) | F.endswith("path", F.concat(F.lit("/"), "tail"))
    whole = whole | F.endswith(bare("path"), F.concat(F.lit("/"), "tail")) if endings else whole
    n = met.groupBy("src", "ref").agg(F.count("*").alias("n"), F.sum(whole.cast("int")).alias("fits"), F.min("path").alias("any"), F.min(F.when(whole, F.col("path"))).alias("fit"))
    return n.where("fits = 1 or fits = 0 and n = 1").select("src", "ref", F.coalesce("fit", "any").alias("path"))


def _tails(path: Column, proper: bool = False) -> Column:
    """All ends of a path that begin at a segment, itself included unless proper."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2 if proper else 1), F.size(parts) + (F.when(F.size(parts) == 1, 1).otherwise(0) if proper else 0)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def locate_reported(reported: DataFrame, files: DataFrame) -> DataFrame:
    """(ref, path): the file that a reported path means: the file of that path, else the only one that ends in it or that
    it ends in, else null. Files (path) are counted by each of their ends first, so a name that a million files share is
    one row, and paths are compared by equality only."""
    refs, files = reported.select("ref").distinct(), files.select("path").distinct()
    ends = files.select("path", F.explode(_tails(F.col("path"))).alias("ref")).groupBy("ref").agg(F.count("*").alias("n"), F.min("path").alias("path"), F.max(F.col("path") == F.col("ref")).alias("same"))
    longer = refs.join(ends, "ref")
    tails = refs.where("instr(ref, '/') > 0").select("ref", F.explode(_tails(F.col("ref"), proper=True)).alias("path"))
    shorter = tails.join(files, "path").select("ref", F.lit(1).cast("long").alias("n"), "path", F.lit(False).alias("same"))
    exact = F.max(F.when(F.col("same"), F.col("ref")))
    n = longer.select("ref", "n", "path", "same").unionByName(shorter).groupBy("ref").agg(F.sum("n").alias("n"), F.min("path").alias("path"), exact.alias("exact"))
    return refs.join(n, "ref", "left").select("ref", F.coalesce("exact", F.when(F.col("n") == 1, F.col("path"))).alias("path"))


def follow(links: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, node, hops, cycle): where following each node's first link (src, dst, place; the smallest place, then dst)
    ends, after `most` hops at most. A walk that comes back to where it has been stops there, and says so. A round takes
    the walks that still go on one hop further, each with the nodes that it has passed, and is written; no round has more
    rows than there are starts."""
    first = written(links.groupBy("src").agg(F.min_by("dst", F.struct("place", "dst")).alias("dst")), "links")
    node = starts.schema["node"].dataType
    live = starts.select("node").distinct().select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"), F.array("node").alias("passed"), F.lit(False).alias("cycle"))
    went, dst, ended = F.col("src").isNotNull(), F.col("dst").cast(node), []
    for _ in range(int(most)):
        step = live.join(first, live.node == first.src, "left")
        moved = lambda then, name: F.when(went, then).otherwise(F.col(name)).alias(name)
        step = step.select("start", moved(dst, "node"), moved(F.col("hops") + 1, "hops"), moved(F.array_append("passed", dst), "passed"), moved(F.array_contains("passed", dst), "cycle"), went.alias("went"))
        step = written(step, "walk")
        goes_on = F.col("went") & F.coalesce(~F.col("cycle"), F.lit(False))
        ended.append(step.where(~goes_on).select("start", "node", "hops", "cycle"))
        live = step.where(goes_on)
        if live.head() is None:
            break
    rows = live.select("start", "node", "hops", "cycle")
    for some in ended:
        rows = rows.unionByName(some)
    return rows


def score(n_in: Column, n_out: Column) -> Column:
    return 3 * F.log1p(n_in) + 0.5 * F.log1p(n_out)


def importance(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out, score) from distinct edges (src, dst)."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    n = ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return n.withColumn("score", score(F.col("n_in"), F.col("n_out")))


def walk(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, hop): nodes within depth steps along src -> dst, with the fewest steps. Edges are written once and each
    frontier too, so a round joins the new frontier alone, and the walk ends where nothing new is met."""
    edges = written(edges.select("src", "dst"), "edges")
    seen = frontier = written(start.select("node").distinct().withColumn("hop", F.lit(0)), "frontier")
    for hop in range(1, depth + 1):
        step = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        if frontier.head() is None:
            break
        seen = seen.unionByName(frontier)
    return seen
