"""Personal data: fixed forms, and identifiers found by bootstrapping over contexts. DataFrame and SQL functions only.

Four fixed forms (email, ip, card, phone) give seed entities. Tokens with a digit are candidate instances. What stands
around a place of one are its lexical patterns: the words before it, what it is glued to (as in `password=`), the word
after it, and, for long runs of letters and digits, their beginning, length and letters. Seeds are trusted;
strings that no one would write by hand are half trusted until their patterns say more. Patterns score by how pure and how many trusted
instances they surround, instances by how well their patterns score, in turn, over the whole corpus's
pattern-instance graph. Places where a high-confidence instance stands in a high-confidence pattern become spans of
kind `id`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

KINDS = ("email", "ip", "card", "phone")
#: What the four kinds must be equal to. A run is only ever matched from its start, or from the end of the last match,
#: and without backtracking; both leave the leftmost non-overlapping matches as they are.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text with a match passes.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9][\x20-]?+[0-9]", "phone": r"\+[0-9]"}
#: Candidate instances: of a token with a digit the first part that has one, less the punctuation around it, of
#: SHORTEST characters or more. Parts end where an assignment, a quotation or a bracket does.
TOKEN = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
CORE = r"""[\p{L}\p{N}+][^\s=:"'`<>(){}\[\],;|]*[\p{L}\p{N}]"""
PART = r"""[^\s0-9=:"'`<>(){}\[\],;|]*+[0-9][^\s=:"'`<>(){}\[\],;|]*+"""
SHORTEST, REACH = 6, 64
#: Strings that no one writes by hand: so many letters and digits in a run, with three of each at least. Before anything
#: is known of their patterns they are trusted this much.
MADE, PRIOR = r"^(?=(?:[A-Za-z]*[0-9]){3})(?=(?:[0-9]*[A-Za-z]){3})[A-Za-z0-9]{16,}$", 0.5

SPAN = "array<struct<start:bigint,kind:string,rank:int,end:bigint,value:string>>"


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's matches, in code points: what splitting leaves gives the gaps."""
    return F.aggregate(
        F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, 1 << 30).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value")),
        F.expr("named_struct('at', 0L, 'found', cast(array() as array<struct<start:bigint,end:bigint,value:string>>))"),
        lambda acc, x: F.when(x["value"].isNull(), acc).otherwise(
            F.struct(
                (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("at"),
                F.concat(acc["found"], F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("end"), x["value"].alias("value")))).alias("found"),
            )
        ),
        lambda acc: acc["found"],
    )


def _luhn(digits: Column) -> Column:
    """Whether the check digit holds: from the right, each second digit doubled, nines cast out."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _sound(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All sound spans of the four kinds, by start and then kind."""
    none = F.expr(f"cast(array() as {SPAN})")

    def of(rank: int, kind: str) -> Column:
        sound = F.filter(_places(text, PATTERNS[kind]), lambda x: _sound(kind, x["value"]))
        spans = F.transform(sound, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["value"].alias("value")))
        return F.when(text.rlike(HINT[kind]), spans).otherwise(none)

    found = [of(*x) for x in enumerate(KINDS)]
    return F.array_sort(F.concat(*found), lambda a, b: F.when(a["start"] * 8 + a["rank"] < b["start"] * 8 + b["rank"], -1).otherwise(1))


def _candidates(text: Column) -> Column:
    """Candidate instances with their patterns; digits in patterns count as one sign."""
    plain = lambda x: F.lower(F.regexp_replace(x, "[0-9]+", "0"))

    def at(x: Column) -> Column:
        core = F.regexp_extract(F.regexp_extract(x["value"], PART, 0), CORE, 0)
        start = x["start"] + F.instr(x["value"], core) - 1
        glued = plain(F.substring(x["value"], F.lit(1), (F.instr(x["value"], core) - 1).cast("int")))
        before = F.split(F.rtrim(F.regexp_replace(F.substring(text, F.greatest(x["start"] - REACH, F.lit(0)).cast("int") + 1, F.least(x["start"], F.lit(REACH)).cast("int")), r"\s+", " ")), " ")
        after = F.split(F.ltrim(F.regexp_replace(F.substring(text, (x["end"] + 1).cast("int"), F.lit(REACH)), r"\s+", " ")), " ")
        last = lambda n: plain(F.array_join(F.slice(before, F.greatest(F.size(before) - n + 1, F.lit(1)), n), " "))
        form = F.when(core.rlike("^[0-9a-f]+$"), "hex").when(core.rlike("^[0-9A-Z]+$"), "upper").otherwise("mixed")
        made = core.rlike(MADE)
        patterns = F.array(
            F.concat(F.lit("<2 "), last(2), F.lit(" | "), glued),
            F.concat(F.lit("<1 "), last(1), F.lit(" | "), glued),
            F.when(glued.rlike("[a-z]"), F.concat(F.lit("= "), glued)),
            F.concat(F.lit("<> "), last(1), F.lit(" | "), glued, F.lit(" | "), plain(after[0])),
            F.when(core.rlike("^[A-Za-z0-9]{16,}$"), F.concat_ws(" ", F.lit("#"), form, F.length(core), F.substring(core, 1, 4))),
        )
        name = F.when(F.length(core) <= 64, core).otherwise(F.sha1(core.cast("binary")))
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), name.alias("inst"), made.alias("made"), F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"))

    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,inst:string,made:boolean,patterns:array<string>>>)")
    return F.when(text.rlike("[0-9]"), F.filter(F.transform(_places(text, TOKEN), at), lambda x: x["end"] - x["start"] >= SHORTEST)).otherwise(none)


def score_graph(graph: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 3) -> tuple[DataFrame, DataFrame]:
    """(pattern, score) and (inst, trust), from distinct edges (pattern, inst, seed, made), after so many rounds.

    An instance starts with a trust of 1 if it is a seed, PRIOR if it is made, else 0. A pattern scores
    pure * (1 - product of (1 - trust)), pure being its share of instances with a trust of PRIOR or more, of which it
    needs `support`; scores below half the confidence count as none. Then an instance's trust is the larger of what it
    started with and 1 - product of (1 - score).
    """
    start = graph.groupBy("inst").agg(F.max(F.when(F.col("seed"), 1.0).when(F.col("made"), PRIOR).otherwise(0.0)).alias("start"))
    start = written(start, "instances")
    trusted = start.select("inst", F.col("start").alias("trust"))
    any_of = lambda c: 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col(c), F.lit(1e-9)))))
    for _ in range(rounds):
        k = F.sum((F.col("trust") >= PRIOR).cast("long"))
        scored = graph.join(trusted, "inst").groupBy("pattern").agg((k / F.count("*") * any_of("trust")).alias("score"), k.alias("k"))
        scored = written(scored.where((F.col("k") >= support) & (F.col("score") >= confidence / 2)).select("pattern", "score"), "patterns")
        up = graph.join(scored, "pattern").groupBy("inst").agg(any_of("score").alias("up"))
        trusted = written(start.join(up, "inst", "left").select("inst", F.greatest("start", F.coalesce("up", F.lit(0.0))).alias("trust")), "trusted")
    return scored, trusted


def personal_spans(docs: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 3) -> DataFrame:
    """(rk, doc_id, base, spans) per row of docs (doc_id long, text string); spans are base's and those of kind `id`.

    rk is a hash of doc_id and text. A pattern and an instance need a score of `confidence`, as score_graph has it.
    What has no digit, or fewer than SHORTEST characters, is no candidate. Null and empty texts have no spans.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    read = src.select(F.xxhash64("doc_id", "text").alias("rk"), "doc_id", base_spans(F.col("text")).alias("base"), _candidates(F.col("text")).alias("cand"))
    read = written(read, "spans")

    # A candidate that overlaps a base span is a seed; it stands for an entity already known.
    seen = read.where("size(cand) > 0").select("rk", "doc_id", "base", F.inline("cand"))
    seen = seen.withColumn("seed", F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start"))))
    seen = written(seen.select("rk", "doc_id", "start", "end", "inst", "made", "seed", F.explode("patterns").alias("pattern")), "candidates")
    graph = written(seen.groupBy("pattern", "inst").agg(F.max("seed").alias("seed"), F.max("made").alias("made")), "graph")
    scored, trusted = score_graph(graph, rounds, confidence, support)
    fine = scored.where(F.col("score") >= confidence).select("pattern")
    sure = trusted.where(F.col("trust") >= confidence).select("inst")
    here = seen.where("not seed").join(fine, "pattern", "left_semi").join(sure, "inst", "left_semi").select("rk", "doc_id", "start", "end").distinct()
    more = here.groupBy("rk", "doc_id").agg(F.collect_list(F.struct("start", F.lit("id").alias("kind"), F.lit(len(KINDS)).alias("rank"), "end", F.lit("").alias("value"))).alias("more"))
    more = more.withColumnsRenamed({"rk": "_rk", "doc_id": "_id"})
    out = read.select("rk", "doc_id", "base").join(more, (F.col("rk") == F.col("_rk")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    every = F.array_sort(F.concat("base", F.col("more").cast(SPAN)), lambda a, b: F.when(a["start"] * 8 + a["rank"] < b["start"] * 8 + b["rank"], -1).otherwise(1))
    return out.select("rk", "doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(every).alias("spans"))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find_personal_data(docs: DataFrame, **how) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    spans lists kind:start:end by start and then kind, in code points, end exclusive; base_sha256 digests that list of
    the four fixed kinds alone. Null and empty texts have empty lists; null doc_ids and repeated rows are returned as
    they are; other columns are ignored, whatever their names.
    """
    found = personal_spans(docs, **how)
    count = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *count, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """text with each run of overlapping spans replaced by the kind of its first, in brackets."""
    runs = F.aggregate(
        spans,
        F.expr("cast(array() as array<struct<start:bigint,end:bigint,kind:string>>)"),
        lambda acc, x: F.when((F.size(acc) == 0) | (F.get(acc, F.size(acc) - 1)["end"] <= x["start"]), F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))).otherwise(
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], x["end"]).alias("end"), F.get(acc, F.size(acc) - 1)["kind"].alias("kind"))))
        ),
    )
    from_ = lambda r, i: F.when(i == 0, 0).otherwise(F.get(r, i - 1)["end"])
    parts = F.transform(runs, lambda x, i: F.concat(F.substring(text, (from_(runs, i) + 1).cast("int"), (x["start"] - from_(runs, i)).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    tail = F.substring(text, (F.get(runs, F.size(runs) - 1)["end"] + 1).cast("int"), F.lit(1 << 30))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(text)


#: Rows with spans are broadcast to the texts up to this many, else joined by shuffle.
BROADCAST_ROWS = 50_000


def redact_personal_data(docs: DataFrame, **how) -> DataFrame:
    """docs with every span in text replaced by its kind; all columns and rows stay, n_chars (where there is one)
    counts the new text. Rows without spans keep their text, null included."""
    found = written(personal_spans(docs, **how).where("size(spans) > 0").dropDuplicates(["rk", "doc_id"]).select(F.col("rk").alias("_rk"), F.col("doc_id").alias("_id"), F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))).alias("_spans")), "redact")
    stats = found.agg(F.count("*"), F.sum(F.size("_spans"))).first()
    few = F.broadcast(found) if stats[0] <= BROADCAST_ROWS and (stats[1] or 0) <= 4 * BROADCAST_ROWS else found
    mine = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = docs.join(few, (mine == F.col("_rk")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("_spans")))
    new = {"text": text} | ({"n_chars": F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.withColumns(new).select(*docs.columns)
