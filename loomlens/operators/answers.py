"""What turns rows into an answer of bounded size: budgets, short forms, and lines of text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlens.functions import text as tx

from . import spans

# Tokens held back for the last lines, bounds of a budget, and what a row of an outline costs besides its label.
RESERVE, LEAST, MOST, DEFAULT = 70, 100, 25_000, 2_000
HANDLE_COST, PLACE_COST, LABEL_MOST = 6, 5, 40
PACKED = 6


def clamp_budget(asked: int | None, default: int = DEFAULT, most: int = MOST) -> int:
    return default if asked is None else min(max(asked, LEAST), most)


def room(budget: int) -> int:
    """What is left of a budget for rows."""
    return budget - min(RESERVE, budget // 2)


def cost(text: Column) -> Column:
    return tx.estimate_tokens(F.concat(text, F.lit("\n")))


def admitted(rows: DataFrame, text: str, order: list, budget: int, by: str | None = None) -> DataFrame:
    """Rows in order while they fit; without `by` only the first `budget` of them are looked at, as each costs a token."""
    few = rows if by else rows.orderBy(*order).limit(budget)
    return spans.budget(few.withColumn("cost", cost(F.col(text))), "cost", order, room(budget), by)


def clamp_tokens(text: Column, most: int) -> Column:
    """text, or its longest beginning that fits with an ellipsis. A token is four characters at most, so only a beginning
    of so many is looked at, and text is worked out once, however long; a longer beginning never costs less, so the
    interval of lengths is halved until one is left."""
    if most <= 0:
        return F.lit("")
    head = F.substring(text, F.lit(1), F.lit(4 * most + 1))
    return F.get(F.transform(F.array(head), lambda x: _clamped(x, most)), F.lit(0))


def _clamped(head: Column, most: int) -> Column:
    cut = lambda n: F.concat(F.substring(head, F.lit(1), n), F.lit("…"))
    # All of 0..low fit, none above high does; low of -1: not even the ellipsis.
    first = F.struct(F.lit(-1).alias("low"), F.least(F.length(head), F.lit(4 * most)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.least(F.floor((s["low"] + s["high"] + 2) / 2).cast("int"), s["high"])
        fits = tx.estimate_tokens(cut(mid)) <= most
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(fits, mid).otherwise(s["low"]).alias("low"), F.when(fits, s["high"]).otherwise(mid - 1).alias("high")))

    steps = (4 * most + 1).bit_length() + 1
    n = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, halve)["low"]
    return F.when(tx.estimate_tokens(head) <= most, head).otherwise(F.concat(F.rtrim(F.substring(head, F.lit(1), F.greatest(n, F.lit(0)))), F.lit("…")))


def plural(n: Column, one: str, more: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {more or one + 's'}"))


def kinds(kind: Column) -> Column:
    """The plural of a kind of symbol."""
    return F.when(kind.endswith("y"), F.concat(F.regexp_replace(kind, "y$", ""), F.lit("ies"))).when(kind.rlike("(?:s|ch|x)$"), F.concat(kind, F.lit("es"))).otherwise(F.concat(kind, F.lit("s")))


def span(path: Column, low: Column, high: Column) -> Column:
    return F.concat(path, F.lit(":"), low.cast("string"), F.when(low == high, "").otherwise(F.concat(F.lit("-"), high.cast("string"))))


def fields(*parts: Column) -> Column:
    return F.concat_ws("  ", *[F.when(p.cast("string") != "", p.cast("string")) for p in parts])


def indent(depth: Column, text: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), F.greatest(depth, F.lit(0)).cast("int")), text)


def detail(symbols: DataFrame, by: str, budget: int) -> DataFrame:
    """(by, fully, named, detail): the most that fits for the symbols (name, kind, signature) of each group."""
    around = HANDLE_COST + PLACE_COST
    full = tx.estimate_tokens(clamp_tokens(F.col("signature"), LABEL_MOST)) + around
    name = tx.estimate_tokens(F.concat("name", F.lit(" ("), "kind", F.lit(")"))) + around
    sums = symbols.groupBy(by).agg(F.sum(full).alias("fully"), F.sum(name).alias("named"))
    return sums.withColumn("detail", F.when(F.col("fully") <= room(budget), "full").when(F.col("named") <= room(budget), "named").otherwise("packed"))


def packed(symbols: DataFrame, by: str) -> DataFrame:
    """(by, first, part, line): distinct names of each kind, PACKED to a line, kinds as they first occur (seq)."""
    names = symbols.groupBy(by, "kind", "name").agg(F.min("seq").alias("seq"))
    lists = names.groupBy(by, "kind").agg(F.min("seq").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]).alias("names"))
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("names") / PACKED).cast("int") - 1), lambda i: F.array_join(F.slice(F.col("names"), i * PACKED + 1, PACKED), ", "))
    rows = lists.select(by, "first", "kind", F.size("names").alias("n"), F.posexplode(chunks).alias("part", "chunk"))
    head = F.concat(F.col("n").cast("string"), F.lit(" "), F.when(F.col("n") == 1, F.col("kind")).otherwise(kinds(F.col("kind"))), F.lit(": "), "chunk")
    return rows.select(by, "first", "part", F.when(F.col("part") == 0, head).otherwise(F.concat(F.lit("  "), "chunk")).alias("line"))


def answer(rows: DataFrame, text: str, order: list, budget: int, title: str, hint: str | None = None) -> DataFrame:
    """(n, line): a title, the rows that fit, and a last line that says what the answer cost and what was left out."""
    kept = admitted(rows, text, order, budget)
    lines = kept.select(F.row_number().over(spans.Window.orderBy(*order)).cast("long").alias("n"), F.col(text).alias("line"))  # as many as the budget has tokens at most
    spent = kept.agg(F.count("*").alias("k"), F.coalesce(F.max("used"), F.lit(0)).alias("used")).crossJoin(F.broadcast(rows.agg(F.count("*").alias("every"))))  # one row
    left = F.col("every") - F.col("k")
    total = F.col("used") + cost(F.lit(title))
    foot = F.concat(F.lit("["), total.cast("string"), F.lit(f"/{budget} tok"), F.when(left > 0, F.concat(F.lit(" · "), left.cast("string"), F.lit(" rows omitted"))).otherwise(""), F.lit("]"))
    ends = [F.struct(F.lit(0).cast("long").alias("n"), F.lit(title).alias("line")), F.struct(F.lit(1 << 40).alias("n"), foot.alias("line"))]
    ends += [F.struct(F.lit((1 << 40) + 1).alias("n"), F.lit(f"next: {hint}").alias("line"))] if hint else []
    return lines.unionByName(spent.select(F.inline(F.array(*ends)))).orderBy("n")


def split_command(command: str) -> list[str]:
    """Words of a command line: quotes of either kind hold white space, and nothing else means anything."""
    found = re.findall(r"""(?:"[^"]*(?:"|$)|'[^']*(?:'|$)|[^\s"'])+""", command)
    return [re.sub(r'''"([^"]*)(?:"|$)|'([^']*)(?:'|$)''', lambda m: m[1] if m[1] is not None else m[2], x) for x in found]
