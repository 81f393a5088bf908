"""Headings and flat declarations of texts with the lines that belong to them, by windows over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEPTHS = 6


def extents(heads: DataFrame, key: str, start: str = "start", depth: str = "depth", last: str | None = None) -> DataFrame:
    """heads with `stop`: the last line (or number) before the next head that stands no deeper, else that of the column
    `last`, else the last head. Depths are 0 to 5. One sort by key; for each depth the nearest following head that is no
    deeper is a running value, so a text with any number of heads is read once."""
    back = Window.partitionBy(key).orderBy(F.desc(start)).rowsBetween(Window.unboundedPreceding, -1)
    follows = [F.last(F.when(F.col(depth) <= d, F.col(start)), ignorenulls=True).over(back) for d in range(DEPTHS)]
    end = F.col(last) if last else F.max(start).over(Window.partitionBy(key))
    rows = heads.withColumn("_follows", F.array(*follows)).withColumn("_end", end)
    return rows.withColumn("stop", F.coalesce(F.get("_follows", F.col(depth)) - 1, F.col("_end"))).drop("_follows", "_end")


def flat_extents(heads: DataFrame, key: str, start: str = "start", last: str | None = None) -> DataFrame:
    """heads with `stop`: the line before the next head, else that of the column `last`, else their own."""
    following = F.lead(start).over(Window.partitionBy(key).orderBy(start)) - 1
    return heads.withColumn("stop", F.greatest(F.col(start), F.coalesce(following, F.col(last) if last else F.col(start))))


def html_headings(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, seq, depth, name): h1 to h6 elements in order, from 1, their names without tags and repeated white space."""
    form = F.lit(r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>")
    found = F.arrays_zip(F.regexp_extract_all(html, form, F.lit(1)).alias("level"), F.regexp_extract_all(html, form, F.lit(2)).alias("inner"))
    each = pages.select(key, F.posexplode(found).alias("i", "h"))
    name = F.trim(F.regexp_replace(F.regexp_replace("h.inner", "<[^>]+>", " "), r"\s+", " "))
    return each.select(key, (F.col("i") + 1).cast("long").alias("seq"), (F.col("h.level").cast("int") - 1).alias("depth"), name.alias("name"))


#: One to six number signs after at most three blanks, then white space or the end.
HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+(.*))?$"


def markdown_headings(lines: DataFrame, key: str, number: str = "line_no", text: str = "line") -> DataFrame:
    """(key, start, depth, name) of lines that are headings and stand in no fence. Number signs at the end belong to the
    name unless white space parts them from it; a fence is closed by the next fence of its kind."""
    w = Window.partitionBy(key).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    fence = F.regexp_extract(text, r"^ {0,3}(```|~~~)", 1)
    fenced = F.sum((fence != "").cast("int")).over(w)
    marked = lines.withColumn("_fenced", F.coalesce(fenced, F.lit(0)) % 2 == 1)
    name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(text, HEADING, 2), r"^#+[ \t]*$", ""), r"[ \t]+#+[ \t]*$", ""))
    heads = marked.where(~F.col("_fenced") & F.col(text).rlike(HEADING))
    return heads.select(key, F.col(number).alias("start"), (F.length(F.regexp_extract(text, HEADING, 1)) - 1).alias("depth"), name.alias("name"))


def config_keys(lines: DataFrame, key: str, number: str = "line_no", text: str = "line") -> DataFrame:
    """(key, start, name) of top-level keys (name: value) and tables ([name])."""
    said = F.coalesce(*[F.when(F.col(text).rlike(p), F.regexp_extract(text, p, 1)) for p in (r"^([A-Za-z_][\w.-]*)[ \t]*:", r"^\[+([^\]]+)\]+")])
    return lines.withColumn("name", said).where("name is not null").select(key, F.col(number).alias("start"), "name")
