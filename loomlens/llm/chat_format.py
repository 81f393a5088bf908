"""Preference formatting: the longest common turn prefix once as prompt, then both completions with their loss masks.

DataFrame functions only. Segments stay rows, one for each turn, so a conversation of any length is never gathered:
where the two sides part is a minimum by pair, and each turn then tells by comparison which part it belongs to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, STOP = "<|{}|>\n", "<|end|>\n"


def _turns(rows: DataFrame) -> DataFrame:
    """Turns with a place: null turns first; rows that share a turn follow by role and text."""
    t = rows.select(F.col("pair_id").cast("long").alias("pair_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return t.withColumn("nth", F.row_number().over(Window.partitionBy("pair_id", "turn").orderBy("role", "text")))


def format_preferences(chosen: DataFrame, rejected: DataFrame, learned: str = "assistant") -> DataFrame:
    """Segments of each pair, from turns (pair_id long, turn long, role string, text string) of its two sides.

    Returns pair_id, part (prompt, chosen or rejected), turn, nth, role, rendered, learn_from, learn_to. Turns are
    compared by turn number, role and text; from the first that differs or that one side lacks, both sides are
    completions. rendered is the turn in the chat form; learn_from and learn_to bound what of it the loss counts, in
    code points: the text and end mark of `learned` turns of completions, else both 0. Null roles and texts count as
    empty, null turns come first (their turn is then returned as null), rows that repeat a turn follow each other by
    role and text, a side without turns makes the other a completion, null pair ids pair with nothing and are left
    out, and other columns are ignored. To train, order a pair's segments by turn and nth.
    """
    a, b = (_turns(x.where("pair_id is not null")) for x in (chosen, rejected))
    key = ["pair_id", "turn", "nth"]
    met = a.join(b.select(*key, F.col("role").alias("role_b"), F.col("text").alias("text_b")), key, "full")
    apart = met.where("not (role <=> role_b and text <=> text_b)").groupBy("pair_id").agg(F.min(F.struct("turn", "nth")).alias("cut"))
    sides = a.withColumn("part", F.lit("chosen")).unionByName(b.withColumn("part", F.lit("rejected"))).join(apart, "pair_id", "left")
    common = F.col("cut").isNull() | (F.struct("turn", "nth") < F.col("cut"))
    out = sides.where((F.col("part") == "chosen") | ~common).withColumn("part", F.when(common, "prompt").otherwise(F.col("part")))
    head = F.concat(F.lit("<|"), "role", F.lit("|>\n"))
    counts = (F.col("part") != "prompt") & (F.col("role") == learned)
    rendered = F.concat(head, "text", F.lit(STOP))
    return out.select(
        "pair_id", "part", F.when(F.col("turn") > -(1 << 62), F.col("turn")).alias("turn"), F.col("nth").cast("long").alias("nth"), "role", rendered.alias("rendered"),
        F.when(counts, F.length(head)).otherwise(0).cast("long").alias("learn_from"), F.when(counts, F.length(rendered)).otherwise(0).cast("long").alias("learn_to"),
    )


def synthetic_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from plain conversations (conv_id, turn, role, text): a conversation as it is, and the
    same with its last assistant turn's text exchanged for that of its neighbour (conv_id with the lowest bit turned),
    or for nothing if the neighbour has none. A conversation without assistant turns has two equal sides."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    last = rows.where("role = 'assistant' and pair_id is not null").groupBy("pair_id").agg(F.max(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), F.coalesce("text", F.lit("")).alias("text"))).alias("l"))
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"), F.col("l.text").alias("other"))
    swap = last.select("pair_id", F.col("l.turn").alias("at"), F.col("l.text").alias("was")).join(other, "pair_id", "left")
    changed = rows.join(swap, "pair_id", "left")
    here = (F.col("role") == "assistant") & (F.coalesce("turn", F.lit(-(1 << 62))) == F.col("at")) & (F.coalesce("text", F.lit("")) == F.col("was"))
    rejected = changed.select("pair_id", "turn", "role", F.when(F.coalesce(here, F.lit(False)), F.coalesce("other", F.lit(""))).otherwise(F.col("text")).alias("text"))
    return rows, rejected


SQL = """
WITH rows AS (SELECT conv_id::BIGINT AS pair_id, coalesce(turn::BIGINT, -4611686018427387904) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT pair_id, turn AS at, text AS was FROM rows WHERE role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC, text DESC) = 1),
swap AS (SELECT l.pair_id, l.at, l.was, coalesce(o.was, '') AS other FROM last l LEFT JOIN last o ON o.pair_id = xor(l.pair_id, 1)),
swapped AS (SELECT r.pair_id, r.turn, r.role, CASE WHEN r.role = 'assistant' AND r.turn = s.at AND r.text = s.was THEN s.other ELSE r.text END AS text
  FROM rows r LEFT JOIN swap s USING (pair_id)),
a AS (SELECT *, row_number() OVER (PARTITION BY pair_id, turn ORDER BY role, text) AS nth FROM rows),
b AS (SELECT *, row_number() OVER (PARTITION BY pair_id, turn ORDER BY role, text) AS nth FROM swapped),
cut AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(ROW(coalesce(a.turn, b.turn), coalesce(a.nth, b.nth))) AS cut
  FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.turn = b.turn AND a.nth = b.nth
  WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY 1),
sides AS (SELECT 'chosen' AS side, * FROM a UNION ALL SELECT 'rejected', * FROM b),
parts AS (SELECT s.*, c.cut IS NULL OR ROW(turn, nth) < c.cut AS common FROM sides s LEFT JOIN cut c USING (pair_id))
SELECT pair_id, CASE WHEN common THEN 'prompt' ELSE side END AS part, CASE WHEN turn > -4611686018427387904 THEN turn END AS turn, nth, role,
  '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
  CASE WHEN NOT common AND role = 'assistant' THEN length(role) + 5 ELSE 0 END::BIGINT AS learn_from,
  CASE WHEN NOT common AND role = 'assistant' THEN length(role) + 5 + length(text) + 8 ELSE 0 END::BIGINT AS learn_to
FROM parts WHERE side = 'chosen' OR NOT common
"""
