"""The structural queries over a source tree, each a DataFrame: map, outline, search, read, define, trace, changes,
diagnose, notes, health. An Index holds the tables they share; all are narrow but `files`, whose content only the queries
that show or match lines read."""

from __future__ import annotations

import functools
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlens.functions import text as tx
from loomlens.operators import answers, graph, index, logs, parse, spans
from loomlens.sources.shared import written

# Endings tried for an import without one, in order; names of directory indexes; manifests; folders that
# hold packages; stems of entry points.
TRY = {
    "typescript": [".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"],
    "python": [".py", ".pyi"],
    "c": [".h", ".c"],
    "cpp": [".hpp", ".h", ".cpp", ".cc"],
    "rust": [".rs"],
    "css": [".css", ".scss"],
    "go": [".go"],
    "java": [".java"],
    "kotlin": [".kt"],
    "csharp": [".cs"],
}
STEM = {"typescript": "index", "javascript": "index", "ruby": "index", "python": "__init__", "rust": "mod"}
MANIFESTS = ("package.json", "Cargo.toml", "go.mod", "pyproject.toml")
GROUPS = ("packages", "apps", "services", "libs", "modules", "crates", "plugins")
ENTRIES = ("index", "main", "app", "server", "cli", "mod", "__init__", "__main__", "lib", "setup")
SCRIPT_ENDINGS = (".js", ".mjs", ".cjs", ".jsx")
PYTHON_ROOTS = ("", "src", "lib", "app")
#: Crates that come with the language.
RUST_OUTSIDE = ("std", "core", "alloc")
#: Languages whose imports are dotted paths, looked up by their end.
DOTTED = ("java", "kotlin", "csharp", "go")


def _bases(path: str, language: str, specifier: str) -> list[str]:
    """Paths without endings that an import may mean, the best first; none for what lies outside the tree.

    A specifier is a way up (as many folders as it says), then names: each language only differs in how it spells that
    and in which folders it may start.
    """
    folders = path.split("/")[:-1]
    if language in ("typescript", "javascript"):
        if specifier[:1] not in (".", "/"):
            return []
        return [specifier.lstrip("/") if specifier[0] == "/" else "/".join([*folders, specifier])]
    if language == "python":
        names = specifier.lstrip(".")
        up, tail = len(specifier) - len(names), names.split(".") if names else []
        if up:
            return ["/".join([*folders, *[".."] * (up - 1), *tail])]
        return ["/".join(filter(None, [root, *tail])) for root in PYTHON_ROOTS]
    if language == "rust":
        names = [x for x in specifier.split("::") if x]
        if not names or names[0] in RUST_OUTSIDE:
            return []
        # A module file stands beside its folder; only mod, lib and main speak for the folder they are in.
        if path.rpartition("/")[2].partition(".")[0] not in ("mod", "lib", "main") and names[0] in ("self", "super"):
            folders = [*folders, path.rpartition("/")[2].partition(".")[0]]
        top = folders[: folders.index("src") + 1] if "src" in folders else folders[:0]
        start = {"crate": top, "self": folders, "super": folders}.get(names[0], folders)
        while names and names[0] in ("crate", "self", "super"):
            start = start[:-1] if names[0] == "super" else start
            names = names[1:]
        # What is imported may be a thing inside a module: ever shorter, down to the folder itself.
        return ["/".join([*start, *names[:k]]) for k in range(len(names), -1, -1)]
    if language in ("c", "cpp", "css", "ruby", "php", "shell"):
        return ["/".join([*folders, specifier.replace("\\", "/")])]
    return []


def candidates(path: str, language: str, specifier: str) -> list[str]:
    """Paths of files that an import may mean, the best first."""
    endings, found = TRY.get(language, []), []
    for base in map(posixpath.normpath, _bases(path, language, specifier)):
        if base == ".." or base.startswith("../"):
            continue
        base = "" if base == "." else base
        stem, ending = posixpath.splitext(base)
        names = [stem, base] if ending in SCRIPT_ENDINGS and language in ("typescript", "javascript") else [base]
        inside = [posixpath.join(base, STEM[language] + e) for e in endings or [".rb"]] if language in STEM else []
        found += [base, *(name + e for name in names if name for e in endings), *inside]
    return [x for x in dict.fromkeys(found) if x]


def ends(language: str, specifier: str) -> str | None:
    """The end of the path of the file that an import of a dotted or bare language means; null where there is no such rule."""
    if language in DOTTED:
        names = [x for x in re.split(r"[./]" if language != "go" else "/", specifier.removesuffix("*")) if x]
        return "/".join(names) + TRY[language][0] if names and language != "go" else None
    if language == "python" and not specifier.startswith("."):
        return specifier.replace(".", "/") + ".py"
    if language in ("c", "cpp", "ruby", "php"):
        return specifier.replace("\\", "/").lstrip("./") or None
    return None


def _references(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(p, i["specifier"], candidates(p, lang, i["specifier"]), ends(lang, i["specifier"])) for p, lang, imports in zip(f["path"], f["language"], f["imports"], strict=True) for i in imports]
        yield pd.DataFrame(rows, columns=["src", "ref", "candidates", "tail"])


def resolve(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """(src, ref, dst) of parsed files' imports: ordered candidates first; then a unique file that the specifier ends."""
    refs = parsed.select("path", "language", "imports").mapInPandas(_references, "src string, ref string, candidates array<string>, tail string")
    first = graph.resolve(refs, files.select("path"))
    loose = refs.where("tail is not null").select("src", "ref", "tail").join(first.where("dst is null").select("src", "ref"), ["src", "ref"])
    one = graph.resolve_ends(loose, files.select("path"))
    return first.join(one, ["src", "ref"], "left").select("src", "ref", F.coalesce("dst", "path").alias("dst"))


#: Raised when the parse stage changes, so that no stored row of an older one is used.
PARSER_VERSION = 2


def parsed_with_cache(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Parsed rows of files (path, size, mtime_ms, content), kept in folder: a file whose path, size and time are there
    under this parser's version is read back, others are parsed and added. Rows of files that are gone stay unread."""
    stamp = ["path", "size", "mtime_ms"]
    place = f"{folder.rstrip('/')}/parser_version={PARSER_VERSION}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    known = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    new = files.where("content is not null")
    if known:
        new = new.join(spark.read.parquet(place).select(*stamp), stamp, "left_anti")
    new = written(new, "unparsed")
    parse.parse_files(new).join(new.select(*stamp), "path").write.mode("append").parquet(place)
    return spark.read.parquet(place).join(files.select(*stamp), stamp, "left_semi").drop("size", "mtime_ms")


class Index:
    """files (path, size, mtime_ms, content), as the workspace source reads them, and what follows from them."""

    def __init__(self, files: DataFrame) -> None:
        self.files = files
        self.parsed = parse.parse_files(files.where("content is not null")).persist()

    @functools.cached_property
    def symbols(self) -> DataFrame:
        flat = self.parsed.select("path", "language", F.posexplode("symbols").alias("seq", "s")).select("path", "language", "seq", "s.*")
        return flat.withColumn("handle", tx.handle(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("kind")))

    @functools.cached_property
    def resolved(self) -> DataFrame:
        return resolve(self.parsed, self.files)

    @functools.cached_property
    def externals(self) -> DataFrame:
        """(src, externals): what a file imports from outside the tree."""
        return self.resolved.where("dst is null").groupBy("src").agg(F.array_sort(F.collect_set("ref")).alias("externals"))

    @functools.cached_property
    def edges(self) -> DataFrame:
        return self.resolved.where("dst is not null and dst <> src").select("src", "dst").distinct()

    @functools.cached_property
    def packages(self) -> DataFrame:
        """(dir, name) of manifests' directories."""
        m = self.files.where(F.element_at(F.split("path", "/"), -1).isin(*MANIFESTS))
        name = F.coalesce(F.get_json_object("content", "$.name"), F.nullif(F.regexp_extract("content", r'(?m)^\s*name\s*=\s*"([^"]+)"', 1), F.lit("")), F.nullif(F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1), F.lit("")))
        folder = F.regexp_replace("path", "/?[^/]+$", "")
        rank = F.array_position(F.array(*map(F.lit, MANIFESTS)), F.element_at(F.split("path", "/"), -1))
        found = m.select(folder.alias("dir"), name.alias("name"), rank.alias("rank"))
        return found.groupBy("dir").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("rank"))).alias("name")).select("dir", F.coalesce("name", F.when(F.col("dir") == "", "(root)").otherwise(F.element_at(F.split("dir", "/"), -1))).alias("name"))

    @functools.cached_property
    def owners(self) -> DataFrame:
        """(path, owner): the deepest package around a file; null unless the tree holds several, one under a group folder."""
        many = self.packages.agg((F.count("*") > 1).alias("several"), F.max(F.arrays_overlap(F.split("dir", "/"), F.array(*map(F.lit, GROUPS)))).alias("grouped"))
        parts = F.split("path", "/")
        each = self.files.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("dir"))
        best = each.join(self.packages, "dir").groupBy("path").agg(F.max_by("name", F.length("dir")).alias("owner"))
        return self.files.select("path").join(best, "path", "left").crossJoin(F.broadcast(many)).select("path", F.when(F.col("several") & F.col("grouped"), F.col("owner")).alias("owner"))  # one row

    @functools.cached_property
    def importance(self) -> DataFrame:
        """(path, language, line_count, n_in, n_out, score)."""
        stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^/]*)?$", 1)
        base = self.parsed.select("path", "language", "line_count", F.size("exports").alias("n_exports"), F.lower(stem).isin(*ENTRIES).alias("entry"))
        n = graph.importance(self.edges).withColumnRenamed("node", "path").drop("score")
        n_in, n_out = F.coalesce("n_in", F.lit(0)), F.coalesce("n_out", F.lit(0))
        score = 3 * F.log1p(n_in) + 0.5 * F.log1p(n_out) + 0.3 * F.log1p("n_exports") + F.when(F.col("entry"), 4).otherwise(0)
        return base.join(n, "path", "left").select("path", "language", "line_count", n_in.alias("n_in"), n_out.alias("n_out"), score.alias("score"))

    def lines(self) -> DataFrame:
        """(path, line, text); what ends with a line break has no empty line after it."""
        every = tx.lines(F.regexp_replace("content", r"\r?\n\z", ""))
        return self.files.where("content is not null").select("path", F.posexplode(every).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), "text")


def _under(df: DataFrame, prefix: str) -> DataFrame:
    prefix = prefix.strip("/")
    return df.where((F.col("path") == prefix) | F.col("path").startswith(prefix + "/")) if prefix and prefix != "." else df


def map_files(ix: Index, prefix: str = "", focus: str | None = None, per_file: int = 0) -> DataFrame:
    """Files by importance, blended with their relevance to focus; with per_file, the first exported symbols of each."""
    rows = ix.importance
    if focus:
        docs = ix.files.where("content is not null").select("path", F.col("content").alias("text"))
        hits = index.top(index.bm25(docs, focus_terms(focus), "path"), 400, "path").withColumnRenamed("score", "s")
        most = hits.agg(F.max("s").alias("most"))
        rows = rows.join(hits, "path", "left").crossJoin(F.broadcast(most))  # one row
        rows = rows.withColumn("score", F.col("score") + F.coalesce(20 * F.col("s") / F.col("most"), F.lit(0.0))).drop("s", "most")
    rows = _under(rows, prefix)
    if per_file:
        top = spans.best(ix.symbols.where("exported and depth = 0"), ["path"], ["seq"], per_file)
        rows = rows.join(top.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "name", "kind", "handle"))).alias("symbols")), "path", "left")
    return rows.orderBy(F.desc("score"), "path")


def map_folders(ix: Index, prefix: str = "", focus: str | None = None) -> DataFrame:
    """map_files with each file's folder: the folder with the best file first, then its files."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    rows = map_files(ix, prefix, focus).withColumn("folder", F.when(folder == "", ".").otherwise(folder))
    best = rows.groupBy("folder").agg(F.max("score").alias("best"))
    return rows.join(best, "folder").orderBy(F.desc("best"), "folder", F.desc("score"), "path")


def tally(ix: Index, prefix: str = "", most: int = 6) -> DataFrame:
    """One row: how many files of which languages, the commonest first."""
    n = _under(ix.parsed, prefix).groupBy("language").count().orderBy(F.desc("count"), "language").limit(most)
    lists = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "language"))), lambda x: F.concat(x["language"], F.lit("×"), (-x["k"]).cast("string")))
    return n.agg(F.array_join(lists, " ").alias("tally"))


def map_tree(ix: Index, prefix: str = "") -> DataFrame:
    """Directories with their own files and lines; those that only hold directories have 0."""
    parts = F.split("path", "/")
    each = _under(ix.parsed, prefix).select("line_count", F.size(parts).alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("i", "dir"))
    own = (F.col("i") == F.col("n") - 1).cast("long")
    return each.groupBy("dir").agg(F.sum(own).alias("files"), F.sum(own * F.col("line_count")).alias("lines")).orderBy("dir")


def outline(ix: Index, path: str, include_private: bool = True, max_depth: int = 5) -> DataFrame:
    rows = _under(ix.symbols, path).where(F.col("depth") <= max_depth)
    return (rows if include_private else rows.where("exported")).orderBy("path", "start_line", "seq")


def outline_lines(ix: Index, path: str, budget: int | None = None, include_private: bool = True, max_depth: int = 5) -> DataFrame:
    """(path, detail, n, line): symbols with signature, else with name and kind, else names packed by kind, whichever fits
    the budget; properties have no handle."""
    budget = answers.clamp_budget(budget)
    rows = outline(ix, path, include_private, max_depth)
    how = answers.detail(rows, "path", budget)
    each = rows.join(how.select("path", "detail"), "path")
    label = F.when(F.col("detail") == "full", answers.clamp_tokens(F.col("signature"), answers.LABEL_MOST)).otherwise(F.concat("name", F.lit(" ("), "kind", F.lit(")")))
    place = F.concat(F.lit(":"), F.col("start_line").cast("string"), F.when(F.col("start_line") == F.col("end_line"), "").otherwise(F.concat(F.lit("-"), F.col("end_line").cast("string"))))
    line = answers.indent(F.col("depth") + 1, answers.fields(F.when(F.col("kind") != "property", F.col("handle")), label, place))
    full = each.where("detail <> 'packed'").select("path", "detail", F.col("seq").cast("long").alias("n"), line.alias("line"))
    pack = answers.packed(each.where("detail = 'packed'"), "path").select("path", F.lit("packed").alias("detail"), (F.col("first") * 1000 + F.col("part")).cast("long").alias("n"), F.concat(F.lit("  "), "line").alias("line"))
    return answers.admitted(full.unionByName(pack), "line", ["path", "n"], budget).select("path", "detail", "n", "line").orderBy("path", "n")


def focus_terms(query: str) -> list[str]:
    """Search terms of a short query: its identifiers lower-cased and their parts."""
    out = []
    for run in re.findall(r"[A-Za-z0-9_$]+", query):
        spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", run))
        out += [run.lower(), *(p.lower() for p in re.split(r"[^A-Za-z0-9]+", spaced) if p)]
    return list(dict.fromkeys(x for x in out if not x[0].isdigit()))


def search(ix: Index, query: str, prefix: str = "", language: str | None = None, files: int = 12, per_file: int = 6) -> DataFrame:
    """(path, rank, line, text, symbol, score): the best line of each symbol in the files that rank highest.

    The file ranking is over the whole tree; prefix and language choose among its first 180.
    """
    docs = ix.files.where("content is not null").select("path", F.col("content").alias("text"))
    top = index.top(index.bm25(docs, focus_terms(query), "path"), 180, "path").join(ix.parsed.select("path", "language"), "path")
    kept = index.top(_under(top if language is None else top.where(F.col("language") == language), prefix), 60, "path").withColumnRenamed("score", "rank")
    words = [re.escape(x) for x in dict.fromkeys([*focus_terms(query), *query.lower().split()]) if len(x) >= 2] or [re.escape(query.lower())]
    n = tx.line_matches(F.col("text"), words)
    hits = ix.lines().join(F.broadcast(kept.select("path", "rank")), "path").where(F.length("text") <= 500).withColumn("n", n).where("n > 0")  # at most 60 rows
    around = spans.enclosing(hits.select("path", "line"), ix.symbols.select("path", F.col("start_line").alias("start"), F.col("end_line").alias("stop"), "depth", F.struct("start_line", "name").alias("name")), "path")
    comment = F.when(F.col("text").rlike(r"^\s*(?://|#|\*)"), 1).otherwise(0)
    at = F.when(F.col("name.start_line") == F.col("line"), 5).when(F.col("name").isNotNull(), 1).otherwise(0)
    rows = hits.join(around, ["path", "line"], "left").withColumn("score", F.col("n") * 2 + at - comment).withColumn("group", F.coalesce("name.start_line", -F.col("line")))
    rows = spans.best(spans.best(rows, ["path", "group"], [F.desc("score"), "line"]), ["path"], [F.desc("score"), "line"], per_file)
    first = rows.select("path", "rank").distinct().orderBy(F.desc("rank"), "path").limit(files)
    return rows.join(F.broadcast(first.select("path")), "path").select("path", "rank", "line", "text", F.col("name.name").alias("symbol"), "score").orderBy(F.desc("rank"), "path", F.desc("score"), "line")


def search_context(ix: Index, hits: DataFrame, around: int = 2) -> DataFrame:
    """(path, line, text, hit): the lines about hits (path, line), each once; hit tells which are hits."""
    low, high = F.greatest(F.col("line") - around, F.lit(1)), F.col("line") + around
    windows = spans.union(hits.select("path", low.alias("low"), high.alias("high")), "path")
    wanted = windows.select("path", F.explode(F.sequence("low", "high")).alias("line"))
    marked = hits.select("path", "line", F.lit(True).alias("hit")).distinct()
    return ix.lines().join(wanted, ["path", "line"]).join(marked, ["path", "line"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))).orderBy("path", "line")


def search_counts(hits: DataFrame) -> DataFrame:
    """One row: lines shown, distinct symbols or loose lines, and files of hits (path, line, symbol)."""
    place = F.coalesce("symbol", F.col("line").cast("string"))
    return hits.agg(F.count("*").alias("hits"), F.count_distinct("path", place).alias("places"), F.count_distinct("path").alias("files"))


def search_symbols(ix: Index, query: str, limit: int = 60) -> DataFrame:
    """Symbols by how their name answers to query: the same, a beginning, a part, or shared words."""
    q, parts = query.lower(), F.array(*[F.lit(x) for x in focus_terms(query)])
    name = F.lower("name")
    base = F.when(name == q, 100).when(name.startswith(q), 60).when(name.contains(q), 40).otherwise(10 * F.size(F.array_intersect(tx.split_identifier(F.col("name")), parts)))
    scored = ix.symbols.withColumn("score", base).where("score > 0").withColumn("score", F.col("score") + F.when(F.col("exported"), 5).otherwise(0) + F.when(F.col("depth") == 0, 3).otherwise(0))
    return scored.orderBy(F.desc("score"), F.collate("path", "UNICODE"), "start_line").limit(limit)


def search_regex(ix: Index, pattern: str, prefix: str = "", files: int = 2500) -> DataFrame:
    """Matching lines of the first files in path order."""
    first = _under(ix.files.where("content is not null"), prefix).select("path").orderBy("path").limit(files)
    return ix.lines().join(F.broadcast(first), "path").where((F.length("text") <= 500) & F.col("text").rlike(pattern)).orderBy("path", "line")


def read(ix: Index, path: str, low: int = 1, high: int = 1 << 30, context: int = 0) -> DataFrame:
    return ix.lines().where(F.col("path") == path).where(F.col("line").between(max(1, low - context), high + context)).select("line", "text").orderBy("line")


def read_symbol(ix: Index, path: str, name: str, context: int = 0) -> DataFrame:
    """The lines of `name` or `Container.name`; the shallowest and exported one first."""
    owner, _, leaf = name.rpartition(".")
    own = ix.symbols.where((F.col("path") == path) & (F.lower("name") == leaf.lower()))
    if owner:
        box = ix.symbols.where((F.col("path") == path) & (F.lower("name") == owner.lower())).select(F.col("start_line").alias("a"), F.col("end_line").alias("b")).orderBy("a").limit(1)
        own = own.join(F.broadcast(box), F.col("start_line").between(F.col("a"), F.col("b")))
    one = own.orderBy("depth", F.desc("exported"), "start_line").limit(1).select("start_line", "end_line")
    return ix.lines().where(F.col("path") == path).join(F.broadcast(one), F.col("line").between(F.col("start_line") - context, F.col("end_line") + context)).select("line", "text").orderBy("line")


def read_handle(ix: Index, handle: str, context: int = 0) -> DataFrame:
    """(path, line, text) of the region that a handle stands for; nothing for one that no symbol has any more."""
    one = ix.symbols.where(F.col("handle") == handle).select("path", (F.col("start_line") - context).alias("low"), (F.col("end_line") + context).alias("high")).limit(1)
    return ix.lines().join(F.broadcast(one), "path").where("line between low and high").select("path", "line", "text").orderBy("line")


def skeleton(ix: Index, path: str, least: int = 4) -> DataFrame:
    """A file's lines with the bodies of functions left out, a mark in the place of each."""
    body = ix.symbols.where(F.col("path") == path).where("kind in ('function', 'method')").select("path", (F.col("start_line") + 1).alias("low"), (F.col("end_line") - 1).alias("high")).where(F.col("high") - F.col("low") + 1 >= least)
    return spans.elided(ix.lines().where(F.col("path") == path), body, "path").select("line", "text").orderBy("line")


def define(ix: Index, symbol: str, source: str | None = None, limit: int = 10) -> DataFrame:
    """Declarations of a symbol: through source's imports and re-exports of up to three hops, else in source, else anywhere."""
    leaf = symbol.rpartition(".")[2]
    named = ix.symbols.where((F.lower("name") == leaf.lower()) & (F.col("name") == leaf))
    anywhere = named.withColumn("via", F.lit("global")).withColumn("prio", F.lit(2))
    if source is None:
        return anywhere.orderBy(F.desc("exported"), "depth", F.collate("path", "UNICODE")).limit(limit).drop("prio")
    imports = ix.parsed.select("path", F.inline("imports")).where(F.array_contains("names", leaf)).select(F.col("path").alias("src"), F.col("specifier").alias("ref"), "line")
    step = imports.join(ix.resolved.where("dst is not null"), ["src", "ref"]).groupBy("src").agg(F.min_by("dst", "line").alias("dst"))
    at, seen = ix.files.where(F.col("path") == source).select("path"), None
    for hop in range(3):
        at = at.join(step, at.path == step.src).select(F.col("dst").alias("path"))
        here = at.withColumn("hop", F.lit(hop))
        seen = here if seen is None else seen.unionByName(here)
    seen = seen.groupBy("path").agg(F.min("hop").alias("hop"))
    through = named.join(seen, "path").withColumn("n", F.min("hop").over(Window.partitionBy())).where("hop = n").drop("hop", "n").withColumn("via", F.lit("import")).withColumn("prio", F.lit(0))
    local = named.where(F.col("path") == source).withColumn("via", F.lit("local")).withColumn("prio", F.lit(1))
    every = through.unionByName(local).unionByName(anywhere)
    return every.withColumn("least", F.min("prio").over(Window.partitionBy())).where("prio = least").orderBy(F.desc("exported"), "depth", F.collate("path", "UNICODE")).limit(limit).drop("prio", "least")  # one name's declarations


def trace(ix: Index, path: str, direction: str = "dependents", depth: int = 1) -> DataFrame:
    """(path, hop, class, owner, crosses): what uses a file, or what it uses, up to depth steps."""
    e = ix.edges if direction == "dependencies" else ix.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = graph.walk(e, ix.files.where(F.col("path") == path).select(F.col("path").alias("node")), min(4, max(1, depth))).where("hop > 0").withColumnRenamed("node", "path")
    mine = ix.owners.where(F.col("path") == path).select(F.col("owner").alias("mine"))
    out = found.join(ix.owners, "path").crossJoin(F.broadcast(mine))  # one row
    return out.select("path", "hop", tx.path_class(F.col("path")).alias("class"), "owner", F.coalesce(F.col("owner") != F.col("mine"), F.lit(False)).alias("crosses")).orderBy("hop", "path")


def trace_externals(ix: Index, path: str, most: int = 20) -> DataFrame:
    """(path, external): what a file imports from outside the tree, in order; its own imports only."""
    return ix.externals.where(F.col("src") == path).select(F.col("src").alias("path"), F.explode(F.slice("externals", 1, most)).alias("external"))


def trace_notes(notes: DataFrame, path: str, most: int = 3, width: int = 160) -> DataFrame:
    """(id, text): the newest notes on a traced file, their texts cut to a width."""
    short = F.when(F.length("text") <= width, F.col("text")).otherwise(F.concat(F.rtrim(F.substring("text", 1, width - 1)), F.lit("…")))
    return notes_on(notes, [path], most).select("id", short.alias("text"))


def locate(ix: Index, target: str) -> DataFrame:
    """(path, symbol, choices): what to trace: a path of the tree, else the files that declare a symbol of that name; only
    where choices is 1 it is clear which."""
    file = ix.files.where(F.col("path") == target.strip("/")).select("path", F.lit(None).cast("string").alias("symbol"), F.lit(0).alias("prio"))
    named = ix.symbols.where(F.col("name") == target).select("path", F.col("name").alias("symbol"), F.lit(1).alias("prio")).distinct()
    both = file.unionByName(named)
    first = both.agg(F.min("prio").alias("first"))
    kept = both.crossJoin(F.broadcast(first)).where("prio = first")  # one row
    return kept.crossJoin(F.broadcast(kept.agg(F.count("*").alias("choices")))).select("path", "symbol", "choices").orderBy("path")  # one row


def notes_on(rows: DataFrame, paths: list[str], limit: int = 5) -> DataFrame:
    """Notes that name any of the paths, the newest first."""
    return rows.where(F.arrays_overlap("paths", F.array(*map(F.lit, paths)))).orderBy(F.desc("created_at"), "id").limit(limit)


def references(ix: Index, path: str, symbol: str, per_file: int = 4) -> DataFrame:
    """Lines of a file's dependents that name a symbol, less their import lines."""
    users = trace(ix, path).select("path")
    imports = ix.parsed.select("path", F.inline("imports")).select("path", "line")
    whole = rf"(?<![A-Za-z0-9_$]){re.escape(symbol)}(?![A-Za-z0-9_$])"
    found = ix.lines().where((F.length("text") <= 500) & F.col("text").rlike(whole)).join(users, "path").join(imports, ["path", "line"], "left_anti")
    return spans.best(found, ["path"], ["line"], per_file).orderBy("path", "line")


def changes(ix: Index, diff: DataFrame, status: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """(path, status, added, removed, symbols, dependents): what a diff (log_id, line_no, text) touched, and the files that a
    status listing has as unknown; of those the ones at or under a prefix."""
    c = logs.changes(diff)
    ranges = c.select(F.col("path"), F.inline("ranges")).withColumnsRenamed({"from": "low", "to": "high"})
    near = ix.symbols.select("path", F.col("start_line").alias("start"), F.col("end_line").alias("stop"), "name")
    fresh = c.where("status = 'added'").select("path").join(ix.symbols.where("depth = 0"), "path").select("path", "name")
    hit = spans.touched(ranges.join(c.where("status <> 'added'").select("path"), "path"), near, "path").select("path", "name").unionByName(fresh)
    names = hit.groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("symbols"))
    used = ix.edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("dependents"))
    more = () if status is None else (logs.untracked(status, c),)
    whole = c if not more else c.unionByName(more[0], allowMissingColumns=True).na.fill(0, ["added", "removed"])
    whole = _under(whole, prefix)
    out = whole.join(names, "path", "left").join(used, "path", "left")
    return out.select("path", "status", "previous", "added", "removed", "symbols", F.coalesce("dependents", F.lit(0)).alias("dependents")).orderBy(F.desc(F.col("added") + F.col("removed")), "path")


def still_imported(ix: Index, changed: DataFrame, most: int = 5) -> DataFrame:
    """(path, by, more): files that a diff deleted although others import them; the first of those, and how many more."""
    used = changed.where("status = 'deleted'").select("path").join(ix.edges.select(F.col("src"), F.col("dst").alias("path")), "path")
    n = used.groupBy("path").agg(F.array_sort(F.collect_set("src")).alias("every"))
    return n.select("path", F.slice("every", 1, most).alias("by"), F.greatest(F.size("every") - most, F.lit(0)).alias("more")).orderBy("path")


def churn(changed: DataFrame) -> DataFrame:
    """One row: files, lines added and lines removed."""
    return changed.agg(F.count("*").alias("files"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"))


def problem_windows(ix: Index, problems: DataFrame, around: int = 2) -> DataFrame:
    """(path, line, text, problem): source about the located problems (file, line) that lie in the tree."""
    at = problems.where("file is not null and line is not null").select(F.col("file").alias("path"), "line").join(ix.files.select("path"), "path", "left_semi")
    return search_context(ix, at, around).withColumnRenamed("hit", "problem")


def by_file(problems: DataFrame) -> DataFrame:
    """(file, n, errors, first): problems of each file, in the order of the first."""
    return problems.groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("errors"), F.min("place").alias("first")).orderBy("first")


def diagnose(ix: Index, log: DataFrame, warnings: bool = False, most: int = 15) -> DataFrame:
    """Problems of a log in reading order, 1 to 100 at most, their files matched to the tree by a unique ending, with the
    symbol around."""
    most = min(max(most, 1), 100)
    found = logs.ranked(logs.diagnostics(log))
    found = found if warnings else found.where("severity = 'error'")
    one = graph.locate_reported(found.where("file is not null").select(F.col("file").alias("ref")), ix.files.select("path")).withColumnRenamed("ref", "file")
    at = found.join(one, "file", "left")
    around = spans.enclosing(at.where("path is not null and line is not null").select("path", "line").distinct(), ix.symbols.select("path", F.col("start_line").alias("start"), F.col("end_line").alias("stop"), "depth", "name"), "path")
    out = at.join(around.withColumnRenamed("name", "symbol"), ["path", "line"], "left")
    return out.where(F.col("place") <= most).select("place", "severity", F.coalesce("path", "file").alias("file"), "line", "col", "code", "message", "source", "symbol").orderBy("place")


def unexplained(log: DataFrame, most: int = 20) -> DataFrame:
    """(log_id, line_no, text): the last lines that say anything of the logs in which no problem was recognised, for a
    failed run that would have no answer else."""
    return logs.tail(log.join(logs.diagnostics(log).select("log_id").distinct(), "log_id", "left_anti"), most)


def notes(rows: DataFrame, query: str = "", path: str | None = None, limit: int = 20) -> DataFrame:
    """Notes (id, text, paths, tags, created_at) that answer to a query, the best first; the newest without one. 1
    to 100 of them."""
    limit = min(max(limit, 1), 100)
    rows = rows if path is None else rows.where(F.array_contains("paths", path))
    if not query.strip():
        return rows.withColumn("score", F.lit(0)).orderBy(F.desc("created_at"), "id").limit(limit)
    low = F.lower(F.concat_ws(" ", "text", F.array_join("tags", " "), F.array_join("paths", " ")))
    score = F.when(low.contains(query.lower().strip()), 5).otherwise(0)
    for word in focus_terms(query):
        score = score + F.when(low.contains(word), 1).otherwise(0)
    return rows.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("created_at"), "id").limit(limit)


NOTES_MOST = 500


def add_note(rows: DataFrame, id: str, text: str, paths: list[str], tags: list[str], created_at: str) -> DataFrame:
    """Notes with one more; the oldest go beyond NOTES_MOST."""
    new = rows.sparkSession.createDataFrame([(id, text.strip(), paths, tags, created_at)], "id string, text string, paths array<string>, tags array<string>, created_at string")
    return rows.unionByName(new).orderBy(F.desc("created_at"), "id").limit(NOTES_MOST)


def remove_note(rows: DataFrame, id: str) -> DataFrame:
    return rows.where(F.col("id") != id)


def missing_paths(ix: Index, paths: list[str]) -> DataFrame:
    """Paths that neither are files of the tree nor hold any."""
    asked = ix.files.sparkSession.createDataFrame([(p.strip("/"),) for p in paths], "path string")
    return path_kinds(ix, asked).where("kind = 'missing'").select("path")


def path_kinds(ix: Index, asked: DataFrame) -> DataFrame:
    """(path, kind): whether each path is a file, a directory or missing in the tree."""
    parts = F.split("path", "/")
    folders = ix.files.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path")).distinct()
    known = ix.files.select("path", F.lit("file").alias("kind")).unionByName(folders.select("path", F.lit("directory").alias("kind"))).groupBy("path").agg(F.max("kind").alias("kind"))
    return asked.join(known, "path", "left").select("path", F.coalesce("kind", F.lit("missing")).alias("kind"))


# Checks by the file that marks them; and names of checks, the most useful first.
DEFAULT_CHECKS = (
    ("Cargo.toml", "cargo:test", "cargo test"),
    ("Cargo.toml", "cargo:check", "cargo check --message-format=short"),
    ("Cargo.toml", "cargo:clippy", "cargo clippy"),
    ("go.mod", "go:test", "go test ./..."),
    ("go.mod", "go:build", "go build ./..."),
    ("go.mod", "go:vet", "go vet ./..."),
    ("pyproject.toml", "py:test", "python3 -m pytest -q"),
    ("pytest.ini", "py:test", "python3 -m pytest -q"),
    ("setup.cfg", "py:test", "python3 -m pytest -q"),
    ("tsconfig.json", "ts:typecheck", "npx --no-install tsc --noEmit"),
)
CHECK_ORDER = ("typecheck", "test", "lint", "build", "check", "tsc", "vitest", "jest")


def checks(files: DataFrame) -> DataFrame:
    """(name, command, origin): checks that a tree declares: scripts of its manifest, targets of its Makefile, and what
    its marker files stand for; the first of a name counts, the most useful come first."""
    spark = files.sparkSession
    top = files.where("path in ('package.json', 'Makefile')").select("path", "content")
    scripts = top.where("path = 'package.json'").select(F.explode(F.json_object_keys(F.get_json_object("content", "$.scripts"))).alias("name")).where(F.col("name").rlike(r"^[A-Za-z0-9_:.-]{1,64}\z"))
    scripts = scripts.select("name", F.concat(F.lit("npm run --silent "), "name").alias("command"), F.lit("package.json").alias("origin"), F.lit(0).alias("rank"))
    lines = top.where("path = 'Makefile'").select(F.explode(tx.lines(F.col("content"))).alias("line"))
    target = F.rtrim(F.substring_index("line", ":", 1))
    targets = lines.where(F.col("line").contains(":") & ~F.substring(F.col("line"), F.instr("line", ":") + 1, F.lit(1)).eqNullSafe("=") & target.rlike(r"^[A-Za-z][A-Za-z0-9_.-]*\z") & (target != "PHONY")).select(target.alias("t")).distinct()
    targets = targets.select(F.concat(F.lit("make:"), "t").alias("name"), F.concat(F.lit("make "), "t").alias("command"), F.lit("Makefile").alias("origin"), F.lit(1).alias("rank"))
    marks = spark.createDataFrame([(o, n, c, 2 + i) for i, (o, n, c) in enumerate(DEFAULT_CHECKS)], "origin string, name string, command string, rank int")
    marks = marks.join(files.select(F.col("path").alias("origin")), "origin", "left_semi").select("name", "command", "origin", "rank")
    every = scripts.unionByName(targets).unionByName(marks)
    first = every.groupBy("name").agg(F.min_by(F.struct("command", "origin"), "rank").alias("c")).select("name", "c.*")
    place = F.array_position(F.array(*map(F.lit, CHECK_ORDER)), F.regexp_replace("name", "^.*:", ""))
    return first.orderBy(F.when(place > 0, place).otherwise(len(CHECK_ORDER) + 1), F.collate("name", "UNICODE"))


def health(ix: Index) -> DataFrame:
    """(level, label, n): what to know before trusting the answers."""
    skipped = ix.files.agg(F.lit("files not read").alias("label"), F.sum(F.col("content").isNull().cast("long")).alias("n"))
    bare = ix.parsed.agg(F.lit("files without symbols").alias("label"), F.sum((F.size("symbols") == 0).cast("long")).alias("n"))
    lost = ix.resolved.agg(F.lit("imports from outside").alias("label"), F.sum(F.col("dst").isNull().cast("long")).alias("n"))
    none = ix.files.agg(F.lit("files").alias("label"), F.count("*").alias("n"))
    every = none.unionByName(skipped).unionByName(bare).unionByName(lost).select("label", F.coalesce("n", F.lit(0)).alias("n"))
    return every.select(F.when((F.col("label") == "files") & (F.col("n") == 0), "fail").when((F.col("label") == "files not read") & (F.col("n") > 0), "warn").otherwise("ok").alias("level"), "label", "n")
