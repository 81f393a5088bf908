"""Diagnostics from logs and ranges from diffs, on tables (log_id, line_no, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlens.sources.shared import fresh

COLUMNS = ("log_id", "line_no", "severity", "file", "line", "col", "code", "message", "source")


#: What a form found, before it is known whether another form found it too; the lowest rank is the most specific.
FOUND = ("rank", "source", "severity", "file", "line", "col", "code", "message")
GENERIC = 9
# How far below its title a failure's first frame is looked for, and how far below its head an arrow.
TITLE_REACH, HEAD_REACH = 24, 3
# Signs before the title of a failed test, a title that is none, and endings of names that are raised.
SIGNS, NO_TITLE, RAISED = ("●", "×", "✕", "✗", "FAIL"), "console", ("Error", "Exception", "Interrupt", "Warning", "Exit")


def _part(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i))


def _number(x: Column) -> Column:
    return F.when(x.rlike("^[0-9]{1,9}$"), x.cast("int"))


def _placed(x: Column) -> Column:
    """(file, line, col) of file:line or file:line:col, read from the right; all null for anything else."""
    p = F.split(x, ":")
    n = F.size(p)
    last, before = _number(F.get(p, n - 1)), _number(F.get(p, n - 2))
    two = last.isNotNull() & before.isNotNull() & (n > 2)
    one = last.isNotNull() & (n > 1)
    file = F.when(two, F.array_join(F.slice(p, F.lit(1), F.greatest(n - 2, F.lit(0))), ":")).when(one, F.array_join(F.slice(p, F.lit(1), F.greatest(n - 1, F.lit(0))), ":"))
    return F.struct(F.when(file != "", file).alias("file"), F.when(two, before).when(one, last).alias("line"), F.when(two, last).alias("col"))


def _ends(file: Column, *endings: str) -> Column:
    return F.coalesce(F.lower(F.substring_index(file, ".", -1)).isin(*endings) & F.contains(file, F.lit(".")), F.lit(False))


def _level(x: Column) -> Column:
    x = F.lower(x)
    return F.when(x.isin("note", "help", "info"), "info").when(x.isin("warning", "warn"), "warning").otherwise("error")


def _problem(fits: Column, rank: int, source: str, severity: Column | str, file=None, line=None, col=None, code=None, message=None) -> Column:
    """A problem as FOUND has it, null where the form doesn't fit."""
    text = lambda x: F.lit(None).cast("string") if x is None else F.when(x != "", x)
    number = lambda x: F.lit(None).cast("int") if x is None else x
    values = (F.lit(rank), F.lit(source), F.lit(severity) if isinstance(severity, str) else _level(severity), text(file), number(line), number(col), text(code), message)
    return F.when(F.coalesce(fits, F.lit(False)), F.struct(*[v.alias(k) for k, v in zip(FOUND, values, strict=True)]))


class _Form:
    """A form: `may` is a plain test that every line of the form passes, `find` gives the problems of lines. Fields are
    what a tool's own signs part; they are columns first, so that a line is parted once, whatever looks at the fields."""

    def __init__(self, may: Column) -> None:
        self.may, self.layers, self.problem = may, ({}, {}, {}), None

    def let(self, x: Column, layer: int = 0) -> Column:
        name = f"_field{layer}_{len(self.layers[layer])}"
        self.layers[layer][name] = x
        return F.col(name)

    def find(self, lines: DataFrame) -> DataFrame:
        for layer in self.layers:
            lines = lines.withColumns(layer) if layer else lines
        return lines.select("log_id", "line_no", "trace", F.inline(F.array(self.problem)))


def _any(t: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(t, F.lit(w))
    return out


def _forms() -> list[_Form]:
    """The tools' forms: t is the line without the white space around it, text as it came."""
    t, raw, lower = F.col("t"), F.col("text"), F.lower("t")
    out: list[_Form] = []

    def form(may: Column):
        out.append(_Form(may))
        return out[-1].let

    def found(*x, **y) -> None:
        out[-1].problem = _problem(*x, **y)

    # tsc, plain: file(line,col): error TS1: message; and pretty: file:line:col - error TS1: message
    for sign, pattern in (("): ", r"\): "), (" - ", " - ")):
        let = form(_any(t, f"{sign}error TS", f"{sign}warning TS"))
        head, tail = let(F.substring_index(t, sign, 1)), let(F.split(t, pattern, 2))
        said = let(F.split(_part(tail, 1), " ", 3), 1)
        code = _part(said, 1)
        fits = _part(said, 0).isin("error", "warning") & code.rlike("^TS[0-9]+:$")
        if sign == " - ":
            at = let(_placed(head), 1)
            file, line, col = at["file"], at["line"], at["col"]
        else:
            inside = let(F.split(F.substring_index(head, "(", -1), ","), 1)
            line, col = _number(_part(inside, 0)), _number(_part(inside, 1))
            file = F.substring(head, F.lit(1), F.length(head) - F.length(F.substring_index(head, "(", -1)) - 1)
            fits &= F.size(inside) == 2
        found(fits & line.isNotNull() & col.isNotNull(), 0, "tsc", _part(said, 0), file, line, col, F.rtrim(code, F.lit(":")), F.coalesce(_part(said, 2), F.lit("")))
    # pytest's summary: FAILED file::test - message; and its last line: file.py:line: NameOfError: message
    let = form(t.startswith("FAILED "))
    said = let(F.split(F.ltrim(F.substring(t, 7, 1 << 20)), " - ", 2))
    node = let(F.split(F.trim(_part(said, 0)), "::", 2), 1)
    found(t.startswith("FAILED ") & (_part(node, 0) != "") & ~F.trim(_part(said, 0)).rlike(r"\s"), 4, "pytest", "error", _part(node, 0), code=_part(node, 1), message=F.coalesce(F.trim(_part(said, 1)), F.lit("test failed")))
    let = form(_any(lower, ".py:") & _any(t, "Error", "Exception"))
    said = let(F.split(t, ":\\s*", 3))
    name = let(F.regexp_extract(_part(said, 2), r"^\w+", 0), 1)
    fits = _ends(_part(said, 0), "py") & _number(_part(said, 1)).isNotNull() & name.rlike("^[A-Z]") & (name.endswith("Error") | name.endswith("Exception"))
    found(fits, 4, "pytest", "error", _part(said, 0), _number(_part(said, 1)), message=_part(said, 2))
    # go build and vet: file.go:line:col: message; go test: --- FAIL: name (time)
    let = form(_any(lower, ".go:"))
    bare = F.regexp_replace(F.regexp_replace(t, "^vet: +", ""), r"^\./", "")
    p = let(F.split(bare, ":"))
    col = let(_number(_part(p, 2)), 1)
    message = let(F.trim(F.array_join(F.slice(p, F.when(col.isNull(), 3).otherwise(4), F.size(p)), ":")), 2)
    found(_ends(_part(p, 0), "go") & _number(_part(p, 1)).isNotNull() & (message != ""), 6, "go", "error", _part(p, 0), _number(_part(p, 1)), col, message=message)
    let = form(t.startswith("--- FAIL:"))
    test = let(_part(F.split(F.ltrim(F.substring(t, 10, 1 << 20)), r"\s+"), 0))
    found(t.startswith("--- FAIL:") & (test != ""), 6, "go", "error", code=test, message=F.concat(F.lit("test failed: "), test))
    # maven: [ERROR] file.java:[line,col] message
    let = form(t.startswith("[") & _any(t, ":["))
    level = let(F.substring_index(F.substring_index(t, "]", 1), "[", -1))
    file = let(F.substring_index(F.ltrim(F.substring(t, F.length(level) + 3, F.lit(1 << 20))), ":[", 1), 1)
    rest = let(F.split(t, ":\\[", 2))
    inside = let(F.split(F.substring_index(_part(rest, 1), "]", 1), ","), 1)
    message = let(F.trim(F.substring(_part(rest, 1), F.length(F.substring_index(_part(rest, 1), "]", 1)) + 2, F.lit(1 << 20))), 1)
    fits = t.startswith("[") & level.isin("ERROR", "WARNING") & _ends(file, "java", "kt") & _number(_part(inside, 1)).isNotNull()
    found(fits & (F.size(inside) == 2) & (message != ""), 7, "maven", level, file, _number(_part(inside, 0)), _number(_part(inside, 1)), message=message)
    # Any tool's file:line:col: error[code]: message, and a bare Error: message after at most one word
    let = form(t.rlike(r"(?i)[0-9][:\s]+(?:error|warning|note)[\[:]"))
    word = r"(?i)^(.*?)[:\s]+(error|warning|note)(?:\[([^\]]*)\])?:\s*(\S.*)$"
    at = let(_placed(let(F.rtrim(F.regexp_extract(t, word, 1), F.lit(": ")))), 1)
    found(at["line"].isNotNull() & at["file"].isNotNull(), GENERIC, "generic", F.regexp_extract(t, word, 2), at["file"], at["line"], at["col"], F.regexp_extract(t, word, 3), F.regexp_extract(t, word, 4))
    let = form(t.rlike(r"^\S*\s*(?:Error|FATAL|Exception) *:"))
    said = let(F.split(t, ":", 2))
    head = let(F.split(F.rtrim(_part(said, 0)), r"\s+"), 1)
    found((F.size(head) <= 2) & F.get(head, F.size(head) - 1).isin("Error", "FATAL", "Exception") & (F.trim(_part(said, 1)) != ""), GENERIC, "generic", "error", message=F.trim(_part(said, 1)))
    # eslint, under the file's own line: line:col  level  message  rule, parted by two blanks or more
    let = form(F.col("above").isNotNull() & t.rlike("^[0-9]") & raw.rlike("^\\s"))
    f = let(F.split(t, r"\s{2,}"))
    place, n, rule = let(F.split(_part(f, 0), ":"), 1), F.size(f), F.get(f, F.size(f) - 1)
    ruled = (n > 3) & rule.rlike("^[\\w@/-]+$")
    fits = raw.rlike("^\\s") & F.col("above").isNotNull() & (F.size(place) == 2) & _number(_part(place, 0)).isNotNull() & _number(_part(place, 1)).isNotNull() & _part(f, 1).isin("error", "warning") & (n > 2)
    message = F.array_join(F.slice(f, F.lit(3), F.greatest(F.when(ruled, n - 3).otherwise(n - 2), F.lit(0))), "  ")
    found(fits, 1, "eslint", _part(f, 1), F.col("above"), _number(_part(place, 0)), _number(_part(place, 1)), F.when(ruled, rule), message)
    # cargo: error[E1]: message, and the place after the arrow below
    let = form(t.startswith("error") | t.startswith("warning"))
    said = let(F.split(t, ":\\s*", 2))
    level, code = let(F.substring_index(_part(said, 0), "[", 1), 1), let(F.substring_index(_part(said, 0), "[", -1), 1)
    fits = level.isin("error", "warning") & (_part(said, 1) != "") & ((code == level) | code.rlike(r"^E[0-9]+\]$"))
    at = let(_placed(let(F.trim(F.substring_index("arrow", "-->", -1)))), 1)
    found(fits, 2, "cargo", level, at["file"], at["line"], at["col"], F.when(code != level, F.rtrim(code, F.lit("]"))), _part(said, 1))
    # python: the first thing raised after Traceback, at the last frame that isn't a library's
    let = form((F.col("trace") > 0) & raw.rlike("^[A-Za-z_][\\w.]*:"))
    head = let(F.substring_index(raw, ":", 1))
    raised = head.rlike("^[A-Za-z_][\\w.]*$") & F.contains(raw, F.lit(":"))
    ending = F.lit(False)
    for e in RAISED:
        ending = ending | head.endswith(e)
    frame = let(F.split("frame", '"'))
    line = _number(F.regexp_extract(_part(frame, 2), "^, line ([0-9]+)", 1))
    found(raised & ending & (F.col("trace") > 0), 3, "python", "error", _part(frame, 1), line, code=head, message=F.ltrim(F.substring(raw, F.length(head) + 2, F.lit(1 << 20))))
    # jest and vitest: a sign and the test's title, and the first frame of the project below
    title, signed = F.lit(None).cast("string"), F.lit(False)
    for sign in SIGNS:
        signed = signed | t.startswith(sign + " ")
        title = F.coalesce(title, F.when(t.startswith(sign + " "), F.trim(F.substring(t, len(sign) + 1, 1 << 20))))
    let = form(signed)
    title = let(title)
    at = let(_placed(F.col("below")))
    found((title != "") & (F.lower(title) != NO_TITLE), 5, "jest", "error", at["file"], at["line"], at["col"], message=title)
    return out


def _framed(t: Column) -> Column:
    """The file:line:col that a stack's line shows: in brackets or after `at`, or the line itself; of the project's
    scripts only."""
    inner = F.when(F.contains(t, F.lit("(")) & t.startswith("at "), F.substring_index(F.substring_index(t, "(", -1), ")", 1)).when(t.startswith("at "), F.substring_index(t, " ", -1)).otherwise(F.rtrim(F.substring_index(t, " ", 1), F.lit(":")))
    at = _placed(inner)
    return F.when(at["col"].isNotNull() & _ends(at["file"], "js", "jsx", "ts", "tsx") & ~F.contains(t, F.lit("node_modules")), inner)


def diagnostics(log: DataFrame) -> DataFrame:
    """Problems that compilers, linters and test runners report; what a specific form found beats the generic form.

    The log is read once: a sort by line gives each line what it needs of others, namely the file's line above, the next
    arrow and the next frame within a bound, and the traceback that it is in. A line is kept once for each form that it may
    have, by form, and each form is tried on its own lines alone: all forms in one step are more code than the JVM compiles.
    A head without a location is a problem without a place.
    """
    w = Window.partitionBy("log_id").orderBy("line_no")
    past, t = w.rowsBetween(Window.unboundedPreceding, 0), F.trim(F.regexp_replace("text", "[\\t\\r]", " "))
    name = F.substring_index(F.rtrim("text"), "/", -1)
    is_file = F.col("text").rlike("^\\S+\\s*$") & name.rlike("\\.\\w+$") & F.locate(":", F.col("text")).isin(0, 2) & F.col("text").rlike("^[/.\\w]")
    trace = F.sum(F.col("text").startswith("Traceback").cast("int")).over(past)
    lines = log.select("log_id", "line_no", "text").withColumn("t", t).withColumns({
        "above": F.last(F.when(is_file, F.rtrim("text")), ignorenulls=True).over(past),
        "arrow": F.first(F.when(F.ltrim("text").startswith("-->"), F.col("text")), ignorenulls=True).over(w.rowsBetween(1, HEAD_REACH)),
        "below": F.first(_framed(t), ignorenulls=True).over(w.rowsBetween(1, TITLE_REACH)),
        "trace": trace,
    })
    # The last frame so far, if it is of the same traceback.
    framed = F.col("t").startswith('File "') & ~F.col("text").rlike("site-packages|/lib/python|<frozen")
    frame = F.last(F.when(framed, F.struct("trace", "text")), ignorenulls=True).over(past)
    lines = lines.withColumn("frame", frame).withColumn("frame", F.when(F.col("frame.trace") == F.col("trace"), F.col("frame.text")))
    forms = _forms()
    may = F.array_compact(F.array(*[F.when(f.may, i) for i, f in enumerate(forms)]))
    lines = lines.withColumn("form", F.explode(may))
    path = fresh(log.sparkSession, "lines")
    lines.write.partitionBy("form").parquet(path)
    # A log in which no line may be a problem has no folder to take the form from.
    lines = log.sparkSession.read.schema(lines.schema).parquet(path)
    every = None
    for i, f in enumerate(forms):
        found = f.find(lines.where(F.col("form") == i)).where("source is not null")
        every = found if every is None else every.unionByName(found)
    # Of what is raised in one traceback the first counts.
    first = F.row_number().over(Window.partitionBy("log_id", "trace", "source").orderBy("line_no"))
    every = every.withColumn("n", F.when(F.col("source") == "python", first).otherwise(1)).where("n = 1")
    key = Window.partitionBy("log_id", "file", "line", F.substring(F.regexp_replace(F.lower("message"), "\\s+", " "), 1, 120))
    kept = every.withColumn("seq", F.min("line_no").over(key)).withColumn("n", F.row_number().over(key.orderBy((F.col("rank") == GENERIC).cast("int"), "rank", "line_no"))).where("n = 1")
    return kept.select(*COLUMNS, "seq")


def ranked(problems: DataFrame) -> DataFrame:
    """Problems of each log in the order to read them: errors first, then those with a place, then as they came."""
    level = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    w = Window.partitionBy("log_id").orderBy(level, F.col("file").isNull(), "seq", "line_no")
    return problems.withColumn("place", F.row_number().over(w))


# What a line of a diff begins with, the longer signs first: the last two are lines that came or went.
HEAD, OLD, NEW, HUNK, CAME, WENT = range(6)
MARKS = ("diff --git ", "--- ", "+++ ", "@@ -", "+", "-")


def _marked(diff: DataFrame) -> DataFrame:
    """Lines that a diff says something by, with their kind; the text only where it is looked at again."""
    kind, text = F.lit(None).cast("int"), F.col("text")
    for i, mark in reversed(list(enumerate(MARKS))):
        kind = F.when(text.startswith(mark), i).otherwise(kind)
    return diff.select("log_id", "line_no", kind.alias("kind"), F.when(kind <= HUNK, text).alias("text")).where("kind is not null")


def changes(diff: DataFrame) -> DataFrame:
    """Files of a unified diff without context, from (log_id, line_no, text): path, status, previous, ranges, added, removed."""
    w, of = Window.partitionBy("log_id").orderBy("line_no"), lambda kind: F.col("kind") == kind
    d = _marked(diff).withColumn("part", F.sum(of(HEAD).cast("int")).over(w)).where("part > 0")
    # A hunk's head says by its third word where it is in the new file: +start or +start,count.
    # Worked out in columns first, once: what stands inside collect_list is worked out anew wherever it is named.
    at = F.when(of(HUNK), F.split(F.substring_index(F.get(F.split("text", " "), F.lit(2)), "+", -1), ","))
    start = F.get("at", F.lit(0)).try_cast("int")
    count = F.coalesce(F.get("at", F.lit(1)).try_cast("int"), F.lit(1))
    low = F.greatest(start, F.lit(1))
    span = F.struct(low.alias("from"), F.when(count > 0, start + count - 1).otherwise(low).alias("to"))
    old, new = F.regexp_extract("text", r"^--- (?:a/)?(.+)$", 1), F.regexp_extract("text", r"^\+\+\+ (?:b/)?(.+)$", 1)
    said = F.when(of(HEAD), F.col("text")).when(of(OLD), old).when(of(NEW), new)
    d = d.withColumn("at", at).select("log_id", "part", "kind", said.alias("said"), F.when(of(HUNK), F.struct("line_no", span.alias("s"))).alias("span"))
    g = d.groupBy("log_id", "part").agg(
        *[F.max(F.when(of(kind), F.col("said"))).alias(name) for kind, name in ((HEAD, "head"), (OLD, "old"), (NEW, "new"))],
        F.transform(F.array_sort(F.collect_list("span")), lambda x: x["s"]).alias("ranges"),
        F.sum(of(CAME).cast("long")).alias("added"), F.sum(of(WENT).cast("long")).alias("removed"),
    )
    # A part has one head.
    g = g.withColumns({name: F.regexp_extract("head", r"^diff --git a/(.+) b/(.+)$", i) for i, name in ((1, "a"), (2, "b"))})
    status = F.when(F.col("old") == "/dev/null", "added").when(F.col("new") == "/dev/null", "deleted").when(F.col("a") != F.col("b"), "renamed").otherwise("modified")
    return g.select("log_id", F.when(F.col("new") == "/dev/null", F.col("a")).otherwise(F.col("b")).alias("path"), status.alias("status"), F.when(F.col("a") != F.col("b"), F.col("a")).alias("previous"), "ranges", "added", "removed")


def untracked(status: DataFrame, changed: DataFrame) -> DataFrame:
    """Files that a status listing (log_id, line_no, text) marks as unknown and the diff's changes do not have."""
    path = F.trim(F.substring("text", 4, 1 << 20))
    rows = status.where(F.col("text").startswith("?? ")).select("log_id", path.alias("path")).where("path <> ''").distinct()
    return rows.join(changed.select("log_id", "path"), ["log_id", "path"], "left_anti").withColumn("status", F.lit("untracked"))


# Branches that others start from, the likeliest first.
BASES = ("origin/main", "origin/master", "main", "master", "origin/develop", "develop")


def default_base(branches: DataFrame) -> DataFrame:
    """(log_id, base): of the branches that a listing (log_id, line_no, text) names, the likeliest to be the base."""
    place = F.array_position(F.array(*map(F.lit, BASES)), F.trim("text"))
    return branches.where(place > 0).groupBy("log_id").agg(F.min_by(F.trim("text"), place).alias("base"))


def tail(log: DataFrame, most: int = 20, width: int = 200) -> DataFrame:
    """The last lines that say anything, for a failed run in which no problem was recognised."""
    w = Window.partitionBy("log_id").orderBy(F.desc("line_no"))
    rows = log.where(F.trim("text") != "").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return rows.select("log_id", "line_no", F.when(F.length("text") <= width, F.col("text")).otherwise(F.concat(F.rtrim(F.substring("text", 1, width - 1)), F.lit("…"))).alias("text"))
