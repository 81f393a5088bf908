"""Every query by name, with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlens.functions import text as tx
from loomlens.operators import answers, edges, graph, ignore, index, logs, outline, parse, scan, segments, spans
from loomlens.operators.spread import spread
from loomlens.sources import feed, notes, workspace
from loomlens.sources.shared import fresh
from loomlens.streaming import follow, handles, upsert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORDS = ["the", "license", "of"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Shared SQL: terms of a text, as functions.text.terms has them.
_PARTS = "list_filter(string_split_regex(regexp_replace(regexp_replace(r, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda p: length(p) > 0)"
_TERMS = f"flatten(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9_$]+'), lambda r: length(r) <= 64 AND NOT regexp_matches(r, '^[0-9]')), lambda r: list_concat([lower(r)], list_filter(list_transform({_PARTS}, lambda p: lower(p)), lambda p: p <> lower(r)))))"
_T = f"t AS (SELECT doc_id, lang, {_TERMS} AS t FROM documents)"
_FLAT = "flat AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM t)"
_POST = "post AS (SELECT doc_id, term, count(*) AS tf, min(pos) AS first FROM flat GROUP BY ALL)"
_BM25 = f"""{_T}, n AS (SELECT doc_id, lang, least(len(list_distinct(t)), 4096) AS n, [least(len(list_filter(t, lambda x: x = w)), 63) for w in ['the', 'license', 'of']] AS h FROM t),
s AS (SELECT count(*) AS nd, avg(n) FILTER (n > 0) AS av, [count(*) FILTER (h[1] > 0), count(*) FILTER (h[2] > 0), count(*) FILTER (h[3] > 0)] AS df FROM n),
scored AS (SELECT doc_id, lang, list_sum([ln(1 + (nd - df[i] + 0.5) / (df[i] + 0.5)) * h[i] * 2.2 / (h[i] + 1.2 * (0.25 + 0.75 * n / av)) for i in [1, 2, 3]]) AS score FROM n, s WHERE h[1] + h[2] + h[3] > 0)"""


@query(f"WITH {_T}, {_FLAT}, {_POST} SELECT doc_id, term, least(tf, 63) AS tf FROM post")
def tokenize_terms(t):
    return index.postings(t("documents")).select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


@query(f"WITH {_T}, {_FLAT}, {_POST} SELECT doc_id, term, least(tf, 63) AS tf, first::BIGINT AS first FROM post QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY first) <= 50")
def term_first_occurrence_cap(t):
    return index.postings(t("documents"), cap=50).select("doc_id", "term", F.col("tf").cast("long").alias("tf"), F.col("first").cast("long").alias("first"))


@query(f"WITH {_T}, {_FLAT} SELECT term, count(DISTINCT doc_id) AS df FROM flat GROUP BY term")
def doc_frequency(t):
    each = spread(t("documents").select("doc_id", "text"), "doc_id").select(F.explode(F.array_distinct(tx.terms(F.col("text")))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {_T} SELECT count(*) AS n_docs, round(avg(len(list_distinct(t))) FILTER (len(t) > 0), 6) AS avg_terms FROM t")
def corpus_stats(t):
    return index.stats(t("documents")).select("n_docs", F.round("avg_terms", 6).alias("avg_terms"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 10")
def bm25_topk(t):
    return index.top(_index(t).search(WORDS), 10).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25}, top AS (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 180) SELECT doc_id, round(score, 6) AS score FROM top WHERE lang = 'en' ORDER BY top.score DESC, doc_id LIMIT 60")
def bm25_filtered_after_topk(t):
    first = index.top(_index(t).search(WORDS), 180)
    kept = first.join(t("documents").select("doc_id", "lang").where("lang = 'en'"), "doc_id")
    return index.top(kept, 60).select("doc_id", F.round("score", 6).alias("score"))


_LINES = "l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS line_no FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS x FROM documents))"


def _lines(t) -> DataFrame:
    return t("documents").select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("line_no", "line")).withColumn("line_no", (F.col("line_no") + 1).cast("long"))


@query(f"WITH {_LINES} SELECT doc_id, line_no, line FROM l")
def line_explode(t):
    return _lines(t)


def _hits(t) -> DataFrame:
    n = tx.line_matches(F.col("line"), ["the", "license", "on"])
    comment = F.when(F.col("line").rlike(r"^\s*(?://|#|\*)"), 1).otherwise(0)
    return _lines(t).where(F.length("line") <= 500).withColumn("n", n.cast("long")).where("n > 0").withColumn("score", F.col("n") * 2 - comment)


_HITS = f"""{_LINES}, h AS (SELECT doc_id, line_no, line, least(len(list_distinct(regexp_extract_all(lower(line), '(^|[^a-z0-9_])(the|license|on)', 2))), 9) AS n FROM l WHERE length(line) <= 500),
hits AS (SELECT doc_id, line_no, n::BIGINT AS n, (n * 2 - CASE WHEN regexp_matches(line, '^\\s*(?://|#|\\*)') THEN 1 ELSE 0 END)::BIGINT AS score FROM h WHERE n > 0)"""


@query(f"WITH {_HITS} SELECT doc_id, line_no, n, score FROM hits")
def line_hits(t):
    return _hits(t).select("doc_id", "line_no", "n", F.col("score").cast("long").alias("score"))


@query(f"WITH {_HITS} SELECT doc_id, line_no // 4 AS block, line_no, score FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, line_no // 4 ORDER BY score DESC, line_no) = 1")
def hits_best_per_group(t):
    h = _hits(t).withColumn("block", F.expr("line_no div 4"))
    return spans.best(h, ["doc_id", "block"], [F.desc("score"), "line_no"]).select("doc_id", "block", "line_no", F.col("score").cast("long").alias("score"))


@query(f"WITH first AS (SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 2500), {_LINES} SELECT doc_id, line_no FROM l SEMI JOIN first USING (doc_id) WHERE regexp_matches(line, '[A-Z][a-z]+ing ')")
def regex_search_capped(t):
    first = t("documents").where("lang = 'en'").select("doc_id").orderBy("doc_id").limit(2500)  # the feature: the first files in order
    return _lines(t).join(F.broadcast(first), "doc_id", "left_semi").where(F.col("line").rlike("[A-Z][a-z]+ing ")).select("doc_id", "line_no")


_COST = r"""(CASE WHEN coalesce(length({0}), 0) = 0 THEN 0 ELSE ceil(length({0}) / (4.0::DOUBLE + (3.1::DOUBLE - 4.0::DOUBLE) * least(1.0, greatest(0.0, ((length({0}) - length(regexp_replace({0}, '[{{}}()\[\]<>=+\-*/%&|^~!?:;,.@#$`"''\\]', '', 'g')))::DOUBLE / length({0}) - 0.03) / 0.12)))
 + (length({0}) - length(replace({0}, chr(10), ''))) * 0.25) END)::BIGINT"""


@query(f"SELECT doc_id, {_COST.format('text')} AS tokens FROM documents")
def estimate_tokens(t):
    return t("documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"WITH c AS (SELECT doc_id, n_chars, {_COST.format('text')} AS cost FROM documents WHERE text <> '') SELECT doc_id, cost, used::BIGINT AS used FROM (SELECT *, sum(cost) OVER (ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM c) WHERE used <= 25000")
def budget_prefix(t):
    rows = t("documents").where("text <> ''").select("doc_id", "n_chars", "text").orderBy("n_chars", "doc_id").limit(25000)  # a text costs a token at least
    rows = rows.select("doc_id", "n_chars", tx.estimate_tokens(F.col("text")).alias("cost"))
    return spans.budget(rows, "cost", ["n_chars", "doc_id"], 25000).select("doc_id", "cost", "used")


@query(f"""WITH c AS (SELECT source, sum({_COST.format('text')} + 11)::BIGINT AS fully, sum({_COST.format("(doc_id || ' (' || lang || ')')")} + 11)::BIGINT AS named FROM documents GROUP BY 1)
SELECT source, fully, named, CASE WHEN fully <= 25000 THEN 'full' WHEN named <= 1000 THEN 'named' ELSE 'packed' END AS detail FROM c""")
def budget_detail_choice(t):
    label = F.concat(F.col("doc_id").cast("string"), F.lit(" ("), "lang", F.lit(")"))
    c = t("documents").groupBy("source").agg(F.sum(tx.estimate_tokens(F.col("text")) + 11).alias("fully"), F.sum(tx.estimate_tokens(label) + 11).alias("named"))
    return c.withColumn("detail", F.when(F.col("fully") <= 25000, "full").when(F.col("named") <= 1000, "named").otherwise("packed"))


@query("SELECT doc_id, 'r' || substr(sha1(source || ':' || doc_id || ':' || n_chars || ':' || lang), 1, 8) AS handle FROM documents")
def handle_ids(t):
    return t("documents").select("doc_id", tx.handle(F.col("source"), F.col("doc_id"), F.col("n_chars"), F.col("lang")).alias("handle"))


@query(f"WITH i AS (SELECT p_partkey, replace(p_name || 'HTTPResponse' || p_type, ' ', '_') AS r FROM part) SELECT p_partkey, array_to_string(list_transform({_PARTS}, lambda p: lower(p)), ' ') AS parts FROM i")
def identifier_split(t):
    name = F.regexp_replace(F.concat("p_name", F.lit("HTTPResponse"), "p_type"), " ", "_")
    return t("part").select("p_partkey", F.array_join(tx.split_identifier(name), " ").alias("parts"))


@query("""WITH p AS (SELECT p_partkey, lower(p_name) AS n FROM part), needle AS (SELECT lower(p_name) AS w FROM part WHERE p_partkey = 1)
SELECT p_partkey, (CASE WHEN n = w THEN 100 WHEN starts_with(n, w[1:4]) THEN 60 WHEN contains(n, w[1:3]) THEN 40 ELSE 10 * len(list_intersect(string_split(n, ' '), string_split(w, ' '))) END)::BIGINT AS score FROM p, needle""")
def symbol_name_score(t):
    needle = t("part").where("p_partkey = 1").select(F.lower("p_name").alias("w"))
    p = t("part").select("p_partkey", F.lower("p_name").alias("n")).crossJoin(F.broadcast(needle))  # one row
    score = F.when(F.col("n") == F.col("w"), 100).when(F.col("n").startswith(F.substring("w", 1, 4)), 60).when(F.col("n").contains(F.substring("w", 1, 3)), 40).otherwise(10 * F.size(F.array_intersect(F.split("n", " "), F.split("w", " "))))
    return p.select("p_partkey", score.cast("long").alias("score"))


@query("WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, string_agg(lang || '×' || n, ' ' ORDER BY n DESC, lang) AS tally FROM c GROUP BY 1")
def lang_tally(t):
    c = t("documents").groupBy("source", "lang").count()
    top = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "lang")))
    return c.groupBy("source").agg(F.array_join(F.transform(top, lambda x: F.concat(x["lang"], F.lit("×"), (-x["k"]).cast("string"))), " ").alias("tally"))


_PATHS = "u AS (SELECT page_id, length(html) AS size, regexp_extract(url, '://([^?#]*)', 1) AS p FROM pages)"


def _paths(t) -> DataFrame:
    return t("pages").select("page_id", F.length("html").cast("long").alias("size"), F.regexp_extract("url", "://([^?#]*)", 1).alias("p"))


@query(f"""WITH {_PATHS}, s AS (SELECT page_id, size, list_filter(string_split(p, '/'), lambda x: x <> '') AS x FROM u),
a AS (SELECT array_to_string(x[1:i], '/') AS dir, CASE WHEN i = len(x) - 1 THEN 1 ELSE 0 END AS own, size FROM (SELECT *, unnest(range(1, len(x))) AS i FROM s))
SELECT dir, sum(own)::BIGINT AS files, sum(own * size)::BIGINT AS bytes FROM a GROUP BY dir""")
def dir_rollup_with_ancestors(t):
    s = _paths(t).select("size", F.filter(F.split("p", "/"), lambda x: x != "").alias("x")).where("size(x) > 1")
    a = s.select("size", "x", F.explode(F.sequence(F.lit(1), F.size("x") - 1)).alias("i"))
    a = a.select(F.array_join(F.slice("x", F.lit(1), F.col("i")), "/").alias("dir"), (F.col("i") == F.size("x") - 1).cast("long").alias("own"), "size")
    return a.groupBy("dir").agg(F.sum("own").alias("files"), F.sum(F.col("own") * F.col("size")).alias("bytes"))


_EDGES = "e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem)"


def _edges(t) -> DataFrame:
    # Distinct as numbers, which are less to move than the names made of them.
    pairs = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    return pairs.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))


_IMPORTANCE = f"{_EDGES}, d AS (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e), imp AS (SELECT node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out, 3 * ln(1 + sum(i)) + 0.5 * ln(1 + sum(o)) AS score FROM d GROUP BY node)"


@query(f"WITH {_IMPORTANCE} SELECT node, n_in, n_out, round(score, 6) AS score FROM imp")
def importance_rank(t):
    return graph.importance(_edges(t)).select("node", "n_in", "n_out", F.round("score", 6).alias("score"))


@query(f"WITH {_IMPORTANCE}, {_BM25}, f AS (SELECT 's' || (doc_id % 100 + 1) AS node, max(score) AS s FROM (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 400) GROUP BY 1) SELECT imp.node, round(imp.score + coalesce(20 * f.s / (SELECT max(s) FROM f), 0), 6) AS score FROM imp LEFT JOIN f ON imp.node = f.node WHERE imp.node LIKE 's%'")
def focus_blend(t):
    top = index.top(_index(t).search(WORDS), 400)
    f = top.groupBy(F.concat(F.lit("s"), F.col("doc_id") % 100 + 1).alias("node")).agg(F.max("score").alias("s"))
    most = F.broadcast(f.agg(F.max("s").alias("most")))  # one row
    imp = graph.importance(_edges(t)).where("node like 's%'").join(f, "node", "left").crossJoin(most)
    return imp.select("node", F.round(F.col("score") + F.coalesce(20 * F.col("s") / F.col("most"), F.lit(0.0)), 6).alias("score"))


@query("SELECT DISTINCT o_orderkey AS src, c_custkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey")
def edges_resolved(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("src"), F.col("c_custkey").alias("dst")).distinct()


_HREF = "h AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)"


def _hrefs(t) -> DataFrame:
    return t("pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("href")).distinct()


@query(f"WITH {_HREF} SELECT page_id, href FROM h ANTI JOIN (SELECT url FROM pages) p ON p.url = h.href")
def edges_external(t):
    return _hrefs(t).join(t("pages").select(F.col("url").alias("href")), "href", "left_anti").select("page_id", "href")


@query(f"""WITH {_PATHS}, {_HREF}, b AS (SELECT page_id AS target, rtrim(p, '/') AS p, regexp_extract(rtrim(p, '/'), '([^/]*)$', 1) AS base FROM u),
r AS (SELECT page_id, href, regexp_replace(regexp_replace(href, '^[a-z]+://', ''), '^/+|/+$', '', 'g') AS tail FROM h),
m AS (SELECT r.page_id, href, count(*) AS n, count(DISTINCT p) FILTER (p = tail OR ends_with(p, '/' || tail)) AS fits, min(p) AS one, min(p) FILTER (p = tail OR ends_with(p, '/' || tail)) AS fit
  FROM r JOIN (SELECT DISTINCT p, base FROM b) b ON b.base = regexp_extract(tail, '([^/]*)$', 1) WHERE tail <> '' GROUP BY ALL)
SELECT h.page_id, h.href, CASE WHEN fits = 1 OR fits = 0 AND n = 1 THEN coalesce(fit, one) END AS target FROM h LEFT JOIN m USING (page_id, href)""")
def suffix_resolve_unique(t):
    h = _hrefs(t)
    tail = F.regexp_replace(F.regexp_replace("href", "^[a-z]+://", ""), "^/+|/+$", "")
    refs = h.select(F.col("page_id").alias("src"), F.col("href").alias("ref"), tail.alias("tail")).where("tail <> ''")
    files = _paths(t).select(F.regexp_replace("p", "/+$", "").alias("path")).distinct()
    one = graph.resolve_ends(refs, files, endings=False).select(F.col("src").alias("page_id"), F.col("ref").alias("href"), F.col("path").alias("target"))
    return h.join(one, ["page_id", "href"], "left")


@query("""WITH c AS (SELECT o_orderkey AS src, o_custkey AS ref, unnest([o_custkey * 7, o_custkey * 3, o_custkey]) AS path, unnest([0, 1, 2]) AS prio FROM orders)
SELECT o_orderkey AS src, o_custkey AS ref, d.dst FROM orders LEFT JOIN (SELECT src, ref, arg_min(path, prio) AS dst FROM c JOIN customer ON c_custkey = path GROUP BY ALL) d ON d.src = o_orderkey AND d.ref = o_custkey""")
def candidate_priority_resolve(t):
    refs = t("orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("ref"), F.expr("array(o_custkey * 7, o_custkey * 3, o_custkey)").alias("candidates"))
    return graph.resolve(refs, t("customer").select(F.col("c_custkey").alias("path")))


_LEFT = """c AS (SELECT o_orderkey AS src, o_custkey AS ref, unnest([o_custkey * 7, o_custkey * 3, o_custkey]) AS path, unnest([0, 1, 2]) AS prio FROM orders),
e AS (SELECT DISTINCT src, dst FROM (SELECT src, ref, arg_min(path, prio) AS dst FROM c JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON c_custkey = path GROUP BY ALL) WHERE src <> dst)"""


@query(f"WITH {_LEFT}, i AS (SELECT dst, count(*) AS n_in FROM e GROUP BY 1), o AS (SELECT src, count(*) AS n_out FROM e GROUP BY 1), n AS (SELECT coalesce(dst, src) AS node, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM i FULL JOIN o ON src = dst) SELECT node, n_in, n_out, round(3 * ln(1 + n_in) + 0.5 * ln(1 + n_out), 6) AS score FROM n")
def edges_batches(t):
    """Importance after customers have come in batches under the references of orders, and some have gone again."""
    view = edges.Edges(t("orders").sparkSession, fresh(t("orders").sparkSession, "edges"))
    refs = t("orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("ref"), F.expr("array(o_custkey * 7, o_custkey * 3, o_custkey)").alias("candidates"))
    files = t("customer").select(F.col("c_custkey").alias("path"))
    view.apply(1, files.where("path % 4 < 2"), refs=refs.where("src % 3 <> 0"))
    view.apply(2, files.where("path % 4 = 2"))
    view.apply(3, files.where("path % 4 = 3"), files.where("path % 10 = 0"), refs.where("src % 3 = 0"))
    return view.importance().select(F.col("node").cast("long").alias("node"), "n_in", "n_out", F.round("score", 6).alias("score"))


def _walk_sql(depth: int) -> str:
    return f"""WITH RECURSIVE {_EDGES}, sym AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
w AS (SELECT 'p1' AS node, 0 AS hop UNION SELECT dst, hop + 1 FROM w JOIN sym ON src = node WHERE hop < {depth}) SELECT node, min(hop)::BIGINT AS hop FROM w GROUP BY node"""


def _walk(t, depth: int) -> DataFrame:
    e = _edges(t)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    start = t("part").where("p_partkey = 1").select(F.lit("p1").alias("node"))
    return graph.walk(both, start, depth).select("node", F.col("hop").cast("long").alias("hop"))


@query(_walk_sql(2))
def bfs_2hop(t):
    return _walk(t, 2)


@query(_walk_sql(4))
def bfs_4hop(t):
    return _walk(t, 4)


_FIRST = "first AS (SELECT o_custkey AS src, arg_min(o_orderkey * 7 % 997 + 1, (o_orderdate, o_orderkey)) AS dst FROM orders WHERE o_custkey % 9 <> 0 GROUP BY 1)"


@query(f"""WITH RECURSIVE {_FIRST}, walk AS (SELECT c_custkey AS start, c_custkey AS node, 0 AS hops, [c_custkey] AS passed, false AS cycle FROM customer
UNION ALL SELECT start, dst, hops + 1, list_append(passed, dst), list_contains(passed, dst) FROM walk JOIN first ON src = node WHERE hops < 12 AND NOT cycle)
SELECT start, arg_max(node, hops) AS node, max(hops)::BIGINT AS hops, arg_max(cycle, hops) AS cycle FROM walk GROUP BY start""")
def follow_links(t):
    """Customers lead on by their first order; some to nowhere, many into a circle."""
    links = t("orders").where("o_custkey % 9 <> 0").selectExpr("o_custkey as src", "o_orderkey * 7 % 997 + 1 as dst", "struct(o_orderdate, o_orderkey) as place")
    return graph.follow(links, t("customer").select(F.col("c_custkey").alias("node")), 12).withColumn("hops", F.col("hops").cast("long"))


@query(f"""WITH {_PATHS}, {_HREF}, f AS (SELECT DISTINCT regexp_replace(p, '/+$', '') AS path FROM u), r AS (SELECT DISTINCT regexp_replace(regexp_replace(href, '^[a-z]+://', ''), '^/+|/+$', '', 'g') AS ref FROM h
UNION SELECT 'build/' || path FROM f UNION SELECT 'app' FROM f),
m AS (SELECT ref, count(*) AS n, min(path) AS path, max(CASE WHEN path = ref THEN path END) AS same FROM r JOIN f ON path = ref OR ends_with(path, '/' || ref) OR ends_with(ref, '/' || path) GROUP BY ref)
SELECT ref, CASE WHEN same IS NOT NULL THEN same WHEN n = 1 THEN m.path END AS path FROM r LEFT JOIN m USING (ref)""")
def locate_reported(t):
    files = _paths(t).select(F.regexp_replace("p", "/+$", "").alias("path"))
    refs = _hrefs(t).select(F.regexp_replace(F.regexp_replace("href", "^[a-z]+://", ""), "^/+|/+$", "").alias("ref"))
    refs = refs.unionByName(files.select(F.concat(F.lit("build/"), "path").alias("ref"))).unionByName(files.select(F.lit("app").alias("ref")))
    return graph.locate_reported(refs, files)


def _rules() -> list[tuple[int, str, str]]:
    """200 rules of every form, over what page paths are made of."""
    forms = ("/en/{0}", "*{1}.html", "de/**/p{0}", "!en/{1}", "{0}/", "/fr/*/{1}*", "!p{0}*", "?{1}", "**/es/{1}/**", "[a-e]*/{0}")
    return [(i, "" if i % 7 else "example.com", forms[i % len(forms)].format(i // 10, i % 10)) for i in range(200)]


def _rule_rows() -> str:
    rows = []
    for number, base, line in _rules():
        r = workspace.compile_rule(line, base)
        rows.append(f"({number}, '{base}', '{r.pattern.pattern}', {str(r.negated).lower()}, {str(r.directory_only).lower()})")
    return ", ".join(rows)


@query(f"""WITH {_PATHS}, r AS (SELECT * FROM (VALUES {_rule_rows()}) v(number, base, pattern, negated, folders)), f AS (SELECT DISTINCT rtrim(p, '/') AS path FROM u WHERE rtrim(p, '/') <> ''),
b AS (SELECT path, number, negated, folders, pattern, CASE WHEN base = '' THEN path ELSE path[length(base) + 2:] END AS rest FROM f JOIN r ON base = '' OR starts_with(path, base || '/')),
a AS (SELECT *, string_split(rest, '/') AS x FROM b), e AS (SELECT path, number, negated, folders, pattern, unnest(list_transform(range(1, len(x) + 1), lambda k: array_to_string(x[1:k], '/'))) AS above, len(x) AS n, unnest(range(1, len(x) + 1)) AS k FROM a),
l AS (SELECT path, max(number) AS number FROM e WHERE regexp_full_match(above, pattern) AND (k < n OR NOT folders) GROUP BY path)
SELECT f.path, number::BIGINT AS rule, coalesce(NOT negated, false) AS ignored FROM f LEFT JOIN l USING (path) LEFT JOIN r USING (number)""")
def ignore_rules(t):
    files = _paths(t).select(F.rtrim(F.regexp_replace("p", "/+$", "")).alias("path"), F.lit(False).alias("is_dir")).where("path <> ''")
    rules = files.sparkSession.createDataFrame(_rules(), "number int, base string, line string")
    return ignore.ignored(files, rules).select("path", "rule", "ignored")


_DIRS = "dirs AS (SELECT unnest(['en', 'en/1', 'en/12', 'fr', 'de/2', '']) AS dir)"


@query(f"""WITH u AS (SELECT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS p FROM pages), {_DIRS}
SELECT page_id, arg_max(dir, length(dir)) AS owner FROM u JOIN dirs ON dir = '' OR p = dir OR starts_with(p, dir || '/') GROUP BY page_id""")
def prefix_owner_longest(t):
    u = t("pages").select("page_id", F.split(F.regexp_extract("url", "://[^/]*/([^?#]*)", 1), "/").alias("x"))
    # A path's folders are looked up one by one, so the join is by equality, not by a scan of all directories.
    each = u.select("page_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("x")), lambda n: F.array_join(F.slice(F.col("x"), F.lit(1), n), "/"))).alias("dir"))
    dirs = u.sparkSession.createDataFrame([(x,) for x in ("en", "en/1", "en/12", "fr", "de/2", "")], "dir string")
    return each.join(F.broadcast(dirs), "dir").groupBy("page_id").agg(F.max_by("dir", F.length("dir")).alias("owner"))


_SPANS = "s AS (SELECT l_orderkey AS k, l_linenumber * 3 AS start, l_linenumber * 3 + (l_quantity::BIGINT) % 9 AS stop, l_linenumber AS depth, 'f' || l_linenumber AS name FROM lineitem)"


def _spans(t) -> DataFrame:
    return t("lineitem").selectExpr("l_orderkey as k", "l_linenumber * 3 as start", "l_linenumber * 3 + cast(l_quantity as bigint) % 9 as stop", "l_linenumber as depth", "concat('f', l_linenumber) as name")


@query(f"""WITH {_SPANS}, p AS (SELECT DISTINCT l_orderkey AS k, l_linenumber * 3 + 4 AS line FROM lineitem)
SELECT k, line::BIGINT AS line, arg_max(name, depth) AS name FROM p JOIN s USING (k) WHERE line BETWEEN start AND stop GROUP BY ALL""")
def enclosing_interval(t):
    points = t("lineitem").selectExpr("l_orderkey as k", "l_linenumber * 3 + 4 as line").distinct()
    return spans.enclosing(points, _spans(t), "k").select("k", F.col("line").cast("long").alias("line"), "name")


@query(f"""WITH {_SPANS}, c AS (SELECT l_orderkey AS k, l_linenumber * 4 AS low, l_linenumber * 4 + 1 AS high FROM lineitem WHERE l_returnflag = 'R'),
m AS (SELECT DISTINCT s.* FROM c JOIN s USING (k) WHERE stop >= low AND start <= high),
kept AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m i WHERE i.k = m.k AND (i.name <> m.name OR i.start <> m.start OR i.stop <> m.stop) AND m.start <= i.start AND m.stop >= i.stop))
SELECT k, name FROM kept UNION ALL SELECT k, name FROM m WHERE k NOT IN (SELECT k FROM kept)""")
def overlap_touched(t):
    changes = t("lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey as k", "l_linenumber * 4 as low", "l_linenumber * 4 + 1 as high")
    return spans.touched(changes, _spans(t), "k").select("k", "name")


_RANGES = "r AS (SELECT l_orderkey AS k, l_linenumber * 5 - 2 AS low, l_linenumber * 5 + (l_quantity::BIGINT) % 4 AS high FROM lineitem)"
_UNION = f"{_RANGES}, w AS (SELECT *, max(high) OVER (PARTITION BY k ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r), g AS (SELECT *, sum(CASE WHEN b IS NULL OR low > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY low, high) AS run FROM w)"


@query(f"WITH {_UNION} SELECT k, min(low)::BIGINT AS low, max(high)::BIGINT AS high FROM g GROUP BY k, run")
def interval_union(t):
    r = t("lineitem").selectExpr("l_orderkey as k", "cast(l_linenumber * 5 - 2 as bigint) as low", "l_linenumber * 5 + cast(l_quantity as bigint) % 4 as high")
    return spans.union(r, "k").select("k", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))


_BODY = f"""{_LINES}, f AS (SELECT doc_id, min(line_no) AS top, max(line_no) AS last FROM l GROUP BY 1), o AS (SELECT doc_id, line_no AS low, line_no + 2 + length(line) % 7 AS high, last FROM l JOIN f USING (doc_id) WHERE line_no % 5 = 2),
body AS (SELECT doc_id, low + 1 AS low, least(high, last) - 1 AS high FROM o WHERE least(high, last) - 1 - low >= 4)"""


@query(f"""WITH {_BODY}, w AS (SELECT *, max(high) OVER (PARTITION BY doc_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM body),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR low > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY low, high) AS run FROM w),
cut AS (SELECT doc_id, min(low) AS low, max(high) AS high FROM g GROUP BY doc_id, run)
SELECT doc_id, line_no, line FROM l WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.doc_id = l.doc_id AND line_no BETWEEN low AND high)
UNION ALL SELECT doc_id, low, '… ' || (high - low + 1) || ' lines' FROM cut""")
def skeleton_elide(t):
    """Bodies (every fifth line begins one, its length says how long) cut out of the lines of a text."""
    lines = _lines(t)
    last = lines.groupBy("doc_id").agg(F.max("line_no").alias("last"))
    body = lines.where("line_no % 5 = 2").join(last, "doc_id").selectExpr("doc_id", "line_no + 1 as low", "least(line_no + 2 + length(line) % 7, last) - 1 as high").where("high - low + 1 >= 4")
    return spans.elided(lines, body, "doc_id", "line_no", "line")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations")
def fill_forward(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t("conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w).alias("asked"))


@query("SELECT conv_id, seg::BIGINT AS seg, min(turn) AS first_turn, count(*) AS n FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS seg FROM conversations) GROUP BY ALL")
def segment_runs(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    seg = t("conversations").withColumn("seg", F.sum((F.col("role") == "user").cast("long")).over(w))
    return seg.groupBy("conv_id", "seg").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


# All lines of all documents as one log: no part of it is a key that a window could be dealt out by.
_ORDER = ["doc_id", "line_no"]
_OVER = "OVER (ORDER BY doc_id, line_no ROWS UNBOUNDED PRECEDING)"


@query(f"WITH {_LINES} SELECT doc_id, line_no, used::BIGINT AS used FROM (SELECT doc_id, line_no, sum(length(line) + 1) {_OVER} AS used FROM l) WHERE used <= 500000")
def scan_budget(t):
    return scan.budget(_lines(t).select(*_ORDER, F.length("line").alias("size")), F.col("size") + 1, _ORDER, 500_000).select(*_ORDER, "used")


@query(f"WITH {_LINES} SELECT doc_id, line_no, last_value(CASE WHEN regexp_matches(line, '^[A-Z]') THEN line[1:20] END IGNORE NULLS) {_OVER} AS head FROM l")
def scan_fill(t):
    head = F.when(F.col("line").rlike("^[A-Z]"), F.substring("line", 1, 20))
    return scan.filled(_lines(t).select(*_ORDER, head.alias("head")), F.col("head"), _ORDER, "filled").select(*_ORDER, F.col("filled").alias("head"))


@query(f"WITH {_LINES} SELECT segment::BIGINT AS segment, count(*) AS lines, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT doc_id, sum(CASE WHEN starts_with(line, 'T') THEN 1 ELSE 0 END) {_OVER} AS segment FROM l) GROUP BY 1")
def scan_segments(t):
    """Segments run on across documents."""
    rows = scan.segments(_lines(t).select(*_ORDER, F.col("line").startswith("T").alias("begins")), F.col("begins"), _ORDER)
    return rows.groupBy("segment").agg(F.count("*").alias("lines"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT h.event_id, min(l.n - h.n)::BIGINT AS after FROM e h JOIN e l ON l.user_id = h.user_id AND l.n BETWEEN h.n + 1 AND h.n + 3 WHERE h.event_type = 'error' AND l.event_type = 'purchase' GROUP BY 1""")
def bounded_forward_match(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ahead = [F.when(F.lead("event_type", i).over(w) == "purchase", i) for i in (1, 2, 3)]  # a bounded window instead of a join
    e = t("events").select("event_id", "event_type", F.coalesce(*ahead).cast("long").alias("after"))
    return e.where("event_type = 'error' and after is not null").select("event_id", "after")


@query("""SELECT doc_id, key FROM (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))[1:120] AS key, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS generic FROM documents)
QUALIFY row_number() OVER (PARTITION BY key ORDER BY generic, doc_id) = 1""")
def dedupe_prefer_specific(t):
    key = F.substring(F.lower(tx.squish(F.col("text"))), 1, 120)
    d = t("documents").select("doc_id", key.alias("key"), (F.col("lang") == "en").cast("int").alias("generic"))
    return d.groupBy("key").agg(F.min_by("doc_id", F.struct("generic", "doc_id")).alias("doc_id")).select("doc_id", "key")


@query("""SELECT event_id, severity, rank FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END::BIGINT AS severity,
row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, props IS NULL, ts, event_id) AS rank FROM events) WHERE rank <= 15""")
def rank_severity_stable(t):
    severity = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    w = Window.partitionBy("user_id").orderBy("severity", F.col("props").isNull(), "ts", "event_id")
    e = t("events").withColumn("severity", severity.cast("long"))
    return e.withColumn("rank", F.row_number().over(w)).where("rank <= 15").select("event_id", "severity", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, 'gone' AS state FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'kept' FROM documents SEMI JOIN labels USING (doc_id)")
def changed_vs_seen(t):
    d, seen = t("documents").select("doc_id"), t("labels").select("doc_id", F.lit(1).alias("seen")).distinct()
    return d.join(seen, "doc_id", "left").select("doc_id", F.when(F.col("seen").isNull(), "gone").otherwise("kept").alias("state"))


_LATEST = "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query(_LATEST)
def upsert_latest(t):
    return upsert.latest(t("events").select("user_id", "event_id", "event_type", "value", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query(_LATEST)
def stream_upsert_latest(t):
    rows = t("events").select("user_id", "event_id", "event_type", "value", "ts")
    spark = rows.sparkSession
    at = fresh(spark, "stream")
    rows.repartition(4).write.parquet(f"{at}/in")
    return upsert.stream_latest(spark, f"{at}/in", rows.schema, "user_id", ["ts", "event_id"], f"{at}/out", f"{at}/state").drop("ts")


@query("SELECT user_id::VARCHAR AS key, count(*) AS n FROM events GROUP BY 1")
def feed_counts(t):
    """Events as a feed of changed users: followed in batches at first, by the full way once far more has come, and once
    more from the checkpoint."""
    rows = t("events").select("event_id", F.col("user_id").alias("key"))
    spark = rows.sparkSession
    at = fresh(spark, "feed")

    def run() -> None:
        q = follow.follow_counts(spark, f"{at}/feed", f"{at}/counts", f"{at}/state", limit=400, overflow=1000)
        q.processAllAvailable()
        q.stop()

    last = rows.agg(F.max("event_id")).first()[0] or 0
    cuts = [-1, min(900, last // 2), last - last // 50, last]
    for part, (low, high) in enumerate(zip(cuts, cuts[1:])):
        feed.publish(rows.where(F.col("event_id").between(low + 1, high)), f"{at}/feed", part, ["event_id"])
        run()
    return follow.counts(spark, f"{at}/counts").select("key", "n")


@query("SELECT 0::BIGINT AS missing, count(*) AS seen, count(DISTINCT user_id) AS users FROM events")
def stream_progress(t):
    """What one running query, asked for twice, has noted of its batches."""
    rows = t("events").select("event_id", "user_id")
    spark = rows.sparkSession
    at = fresh(spark, "progress")
    rows.repartition(6).write.parquet(f"{at}/in")
    listener = follow.Progress(spark, f"{at}/progress")
    spark.streams.addListener(listener)

    def start():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
        return stream.writeStream.queryName(at.rpartition("/")[2]).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(processingTime="0 seconds").start()

    asked = [follow.shared(spark, at.rpartition("/")[2], start) for _ in range(2)]
    asked[1].processAllAvailable()
    asked[0].stop()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(listener)
    seen = follow.progress(spark, f"{at}/progress").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("seen"))
    out = spark.read.schema(rows.schema).parquet(f"{at}/out").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return seen.crossJoin(out).select((F.col("seen") - F.col("n")).alias("missing"), "seen", "users")  # one row each


_USES = "SELECT user_id::VARCHAR AS user, 'r' || substr(sha1(event_type || ':' || event_id % 40 || ':' || (event_id % 40 + 3) || ':event'), 1, 8) AS handle, event_id AS used FROM events"


@query(f'WITH u AS ({_USES}), m AS (SELECT "user", handle, max(used) AS used FROM u GROUP BY ALL) SELECT "user", handle, used FROM m QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY used DESC) <= 16')
def handles_last_used(t):
    """Handles that users' stores of 16 hold after all events."""
    spark = t("events").sparkSession
    at = fresh(spark, "handles")
    place = F.col("event_id") % 40
    uses = t("events").select(F.col("user_id").cast("string").alias("user"), tx.handle(F.col("event_type"), place, place + 3, F.lit("event")).alias("handle"), F.col("event_id").alias("used"))
    uses.repartitionByRange(3, "used").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(uses.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    handles.keep_handles(stream, f"{at}/state", f"{at}/evicted", 16).awaitTermination()
    return handles.handles(spark, f"{at}/state")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.page') AS page FROM events")
def json_field(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.page").alias("page"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'tests/' WHEN 1 THEN 'docs/' ELSE '' END || regexp_extract(url, '://[^/]*/([^?#]*)', 1) || CASE WHEN page_id % 3 = 0 THEN '/index.ts' ELSE '.ts' END AS path FROM pages),
x AS (SELECT page_id, path, string_split(lower(path), '/') AS parts, string_split(string_split(lower(path), '/')[-1], '.') AS w FROM p), y AS (SELECT *, parts[1:len(parts) - 1] AS folders, len(w) AS n FROM x)
SELECT page_id, path, CASE WHEN list_has_any(folders, ['test', 'tests', '__tests__', 'spec']) OR n > 2 AND w[-2] IN ('test', 'spec') AND w[-1] <> '' OR starts_with(w[1], 'test_') AND n > 1 AND w[-1] = 'py' THEN 'test'
WHEN list_has_any(folders, ['example', 'examples', 'sample', 'samples', 'doc', 'docs']) THEN 'example' WHEN n = 2 AND w[1] IN ('index', 'main', 'cli', 'app', 'server') AND w[-1] <> '' THEN 'entrypoint' END AS class FROM y""")
def classify_paths(t):
    path = F.expr("concat(case page_id % 4 when 0 then 'tests/' when 1 then 'docs/' else '' end, regexp_extract(url, '://[^/]*/([^?#]*)', 1), case when page_id % 3 = 0 then '/index.ts' else '.ts' end)")
    return t("pages").select("page_id", path.alias("path")).withColumn("class", tx.path_class(F.col("path")))


@query("""SELECT item_id, score FROM (SELECT item_id, (CASE WHEN contains(lower(text), 'the on') THEN 5 ELSE 0 END + CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'on') THEN 1 ELSE 0 END)::BIGINT AS score FROM benchmark) WHERE score > 0 ORDER BY score DESC, item_id LIMIT 20""")
def note_search(t):
    low = F.lower("text")
    score = F.when(low.contains("the on"), 5).otherwise(0) + F.when(low.contains("the"), 1).otherwise(0) + F.when(low.contains("on"), 1).otherwise(0)
    return t("benchmark").select("item_id", score.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), "item_id").limit(20)


@query("SELECT item_id::VARCHAR AS id, text, [item_id % 3 || '.md'] AS paths, '2026-01-' || lpad((item_id % 28 + 1)::VARCHAR, 2, '0') AS created_at FROM benchmark ORDER BY created_at DESC, id DESC LIMIT 500")
def notes_written(t):
    """Benchmark items as notes: written in two goes, the second over some of the first, and read back."""
    rows = t("benchmark").selectExpr("cast(item_id as string) as id", "text", "array(concat(item_id % 3, '.md')) as paths", "array('b') as tags", "concat('2026-01-', lpad(item_id % 28 + 1, 2, '0')) as created_at")
    spark = rows.sparkSession
    spark.dataSource.register(notes.Notes)
    at = fresh(spark, "notes")
    for part in (rows.where("length(id) % 2 = 0"), rows):
        part.repartition(3).write.format("notes").mode("append").save(at)
    return spark.read.format("notes").load(at).select("id", "text", "paths", "created_at")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name COLLATE en_us, p_partkey) AS place FROM part QUALIFY place <= 100")
def locale_order(t):
    first = t("part").orderBy(F.collate("p_name", "UNICODE"), "p_partkey").limit(100)  # the first page of a listing
    return first.select("p_partkey", F.row_number().over(Window.orderBy(F.collate("p_name", "UNICODE"), "p_partkey")).cast("long").alias("place"))


_HEADS = """h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1)) AS level, unnest(regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2)) AS inner_html,
  generate_subscripts(regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1), 1) AS i FROM pages),
o AS (SELECT page_id, level::INT - 1 AS depth, trim(regexp_replace(regexp_replace(inner_html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS name, i FROM h)"""


@query(f"""WITH {_HEADS} SELECT page_id, i::BIGINT AS seq, name, depth::BIGINT AS depth,
coalesce((SELECT min(x.i) FROM o x WHERE x.page_id = o.page_id AND x.i > o.i AND x.depth <= o.depth) - 1, (SELECT max(x.i) FROM o x WHERE x.page_id = o.page_id))::BIGINT AS last FROM o""")
def html_outline(t):
    """Headings of pages in order, each with the last heading that stands under it."""
    found = outline.extents(outline.html_headings(t("pages"), "page_id"), "page_id", "seq")
    return found.select("page_id", "seq", "name", F.col("depth").cast("long").alias("depth"), F.col("stop").alias("last"))


# Pages as Markdown: a heading a line, every third with number signs after it, and a fence around every fifth.
_MARKED = f"""{_HEADS}, md AS (SELECT page_id, unnest(CASE WHEN i % 5 = 0 THEN ['```', x, '```'] ELSE [x] END) AS line, i, generate_subscripts(CASE WHEN i % 5 = 0 THEN ['```', x, '```'] ELSE [x] END, 1) AS k
FROM (SELECT page_id, i, repeat('#', depth + 1) || ' ' || name || CASE WHEN i % 3 = 0 THEN ' ##' ELSE '' END AS x FROM o)),
ml AS (SELECT page_id, line, i, row_number() OVER (PARTITION BY page_id ORDER BY i, k) AS line_no, count(*) OVER (PARTITION BY page_id) AS n FROM md),
hs AS (SELECT page_id, line_no AS start, n, depth, name FROM ml JOIN o USING (page_id, i) WHERE i % 5 <> 0)"""


@query(f"""WITH {_MARKED} SELECT page_id, start, depth::BIGINT AS depth, trim(regexp_replace(name, '(^|[ \t]+)#+[ \t]*$', '')) AS name,
coalesce((SELECT min(x.start) FROM hs x WHERE x.page_id = hs.page_id AND x.start > hs.start AND x.depth <= hs.depth) - 1, n)::BIGINT AS stop FROM hs""")
def markdown_outline(t):
    h = outline.html_headings(t("pages"), "page_id")
    line = F.concat(F.expr("repeat('#', depth + 1)"), F.lit(" "), "name", F.when(F.col("seq") % 3 == 0, " ##").otherwise(""))
    some = F.when(F.col("seq") % 5 == 0, F.array(F.lit("```"), line, F.lit("```"))).otherwise(F.array(line))
    w = Window.partitionBy("page_id").orderBy("seq", "k")
    lines = h.select("page_id", "seq", F.posexplode(some).alias("k", "line")).withColumn("line_no", F.row_number().over(w).cast("long"))
    n = lines.groupBy("page_id").agg(F.max("line_no").alias("n"))
    found = outline.extents(outline.markdown_headings(lines, "page_id").join(n, "page_id"), "page_id", last="n")
    return found.select("page_id", "start", F.col("depth").cast("long").alias("depth"), "name", "stop")


@query("""WITH k AS (SELECT conv_id, turn AS start, role AS name FROM conversations WHERE turn % 3 = 2 OR turn % 2 = 0), n AS (SELECT conv_id, max(turn) AS n FROM conversations GROUP BY 1)
SELECT conv_id, start, name, coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY start) - 1, n)::BIGINT AS stop FROM k JOIN n USING (conv_id)""")
def config_outline(t):
    """Conversations as configuration: a turn is a table's head, a key with its value, or a line that goes on."""
    text = F.regexp_replace("text", "[\r\n]+", " ")
    line = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("["), "role", F.lit("]"))).when(F.col("turn") % 2 == 0, F.concat("role", F.lit(": "), text)).otherwise(F.concat(F.lit("  "), text))
    lines = t("conversations").select("conv_id", F.col("turn").alias("line_no"), line.alias("line"))
    keys = outline.config_keys(lines, "conv_id").join(lines.groupBy("conv_id").agg(F.max("line_no").alias("n")), "conv_id")
    return outline.flat_extents(keys, "conv_id", last="n").select("conv_id", "start", "name", "stop")


@query()
def mask_source(t):
    """Symbols and imports of every text read as source: prose has few, and the stage must get through it."""
    files = t("documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"), F.col("text").alias("content"))
    return parse.parse_files(files).select("path", "line_count", F.size("symbols").alias("n_symbols"), F.size("imports").alias("n_imports"))


_stored: dict[tuple[str, str], str] = {}


def _index(t) -> segments.Store:
    """The stored index of the documents, built once for a session and the files as they are, then only read."""
    docs = t("documents").select("doc_id", "text")
    spark = docs.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = [jvm.org.apache.hadoop.fs.Path(f) for f in sorted(docs.inputFiles())]
    state = [p.getFileSystem(conf).getFileStatus(p) for p in files]
    key = (spark.sparkContext.applicationId, str([(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in state]))
    if key not in _stored:
        folder = fresh(spark, "index")
        segments.Store(spark, folder).apply(0, docs)
        _stored[key] = folder
    return segments.Store(spark, _stored[key])


def _names(t) -> DataFrame:
    """A text's first three words, as if they were the names of what it declares."""
    return t("documents").select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("name"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 10")
def postings_search(t):
    return index.top(_index(t).search(WORDS), 10).select("doc_id", F.round("score", 6).alias("score"))


_EDITED = """l AS (SELECT doc_id, min(quality) AS q, max(toxic) AS x FROM labels GROUP BY 1),
v AS (SELECT d.doc_id, d.lang, CASE WHEN q = 1 AND d.doc_id % 3 = 0 THEN 'license ' || text WHEN x = 1 THEN text || ' the license' ELSE text END AS text FROM documents d LEFT JOIN l USING (doc_id) WHERE coalesce(q, 1) <> 0)"""


@query(f"WITH {_EDITED}, {_BM25.replace('FROM documents', 'FROM v')} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 50")
def index_batches(t):
    """An index that four batches of new, edited and deleted texts have made, the last of them twice."""
    docs, spark = t("documents").select("doc_id", "text"), t("documents").sparkSession
    marks = t("labels").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("x"))
    toxic = docs.join(marks.where("x = 1"), "doc_id").select("doc_id", F.concat("text", F.lit(" the license")).alias("text"))
    good = docs.join(marks.where("q = 1 and doc_id % 3 = 0"), "doc_id").select("doc_id", F.concat(F.lit("license "), "text").alias("text"))
    store = segments.Store(spark, fresh(spark, "index"))
    store.apply(1, docs.where("doc_id % 2 = 0"))
    store.apply(2, docs.where("doc_id % 4 = 1"))
    # What is new comes with edits of what is there already; no key twice.
    store.apply(3, docs.where("doc_id % 4 = 3").join(toxic.select("doc_id"), "doc_id", "left_anti").unionByName(toxic))
    for _ in range(2):
        store.apply(4, good, marks.where("q = 0"))
    return index.top(store.search(WORDS), 50).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_T}, {_FLAT}, {_POST}, names AS (SELECT doc_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS text FROM documents),
said AS (SELECT doc_id, unnest({_TERMS}) AS term FROM names), times AS (SELECT doc_id, term, count(*) AS times FROM said GROUP BY ALL)
SELECT doc_id, term, least(least(tf, 63) + 3 * coalesce(times, 0), 63) AS tf FROM post LEFT JOIN times USING (doc_id, term)""")
def symbol_boost(t):
    return index.boosted(index.postings(t("documents")).select("doc_id", "term", "tf"), _names(t)).select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


_ROW = "doc_id || ' ' || lang || ' ' || coalesce(source, '')"


@query(f"""WITH c AS (SELECT doc_id, n_chars, {_COST.format(f"({_ROW} || chr(10))")} AS cost FROM documents), u AS (SELECT *, sum(cost) OVER (ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM c)
SELECT doc_id, cost, used::BIGINT AS used FROM u WHERE used <= 2000 - 70""")
def budget_reserve(t):
    row = F.concat(F.col("doc_id").cast("string"), F.lit(" "), "lang", F.lit(" "), F.coalesce("source", F.lit("")))
    return answers.admitted(t("documents").select("doc_id", "n_chars", row.alias("row")), "row", ["n_chars", "doc_id"], answers.clamp_budget(None)).select("doc_id", "cost", "used")


@query(f"""WITH s AS (SELECT doc_id, replace(text, chr(10), ' ') AS x FROM documents), n AS (SELECT doc_id, x, unnest(range(0, least(length(x), 48) + 1)) AS n FROM s), e AS (SELECT doc_id, x, n, x[1:n] || '…' AS cut FROM n),
m AS (SELECT doc_id, max(n) FILTER ({_COST.format('cut')} <= 12) AS n FROM e GROUP BY 1)
SELECT doc_id, CASE WHEN {_COST.format('x')} <= 12 THEN x ELSE rtrim(x[1:coalesce(n, 0)], ' ') || '…' END AS label FROM s LEFT JOIN m USING (doc_id)""")
def clamp_tokens(t):
    return t("documents").select("doc_id", answers.clamp_tokens(F.translate("text", "\n", " "), 12).alias("label"))


@query("""WITH s AS (SELECT source AS folder, lang AS kind, 'n' || (n_chars % 40) AS name, min(doc_id) AS seq FROM documents GROUP BY ALL), k AS (SELECT folder, kind, min(seq) AS first, list(name ORDER BY seq) AS names FROM s GROUP BY ALL),
c AS (SELECT *, unnest(range(0, (len(names) + 5) // 6)) AS part FROM k)
SELECT folder, kind, part::BIGINT AS part, CASE WHEN part = 0 THEN len(names) || ' ' || CASE WHEN len(names) = 1 THEN kind WHEN kind LIKE '%y' THEN kind[:-2] || 'ies' WHEN regexp_matches(kind, '(s|ch|x)$') THEN kind || 'es' ELSE kind || 's' END || ': ' ELSE '  ' END
  || array_to_string(names[part * 6 + 1:part * 6 + 6], ', ') AS line FROM c""")
def names_packed(t):
    rows = t("documents").select(F.col("source").alias("folder"), F.col("lang").alias("kind"), F.concat(F.lit("n"), (F.col("n_chars") % 40).cast("string")).alias("name"), F.col("doc_id").alias("seq"))
    kinds = rows.groupBy("folder", "kind").agg(F.min("seq").alias("first"))
    return answers.packed(rows, "folder").join(kinds, ["folder", "first"]).select("folder", "kind", F.col("part").cast("long").alias("part"), "line")


@query(f"""WITH {_BM25}, d AS (SELECT doc_id, doc_id // 50 AS folder, score FROM scored), g AS (SELECT folder, max(score) AS best FROM d GROUP BY 1)
SELECT doc_id, folder, row_number() OVER (ORDER BY best DESC, folder, score DESC, doc_id) AS place FROM d JOIN g USING (folder) QUALIFY place <= 200""")
def folders_by_best(t):
    d = _index(t).search(WORDS).withColumn("folder", F.expr("doc_id div 50"))
    best = d.groupBy("folder").agg(F.max("score").alias("best"))
    order = [F.desc("best"), "folder", F.desc("score"), "doc_id"]
    first = d.join(best, "folder").orderBy(*order).limit(200)  # the first page of a listing
    return first.select("doc_id", "folder", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query(f"""WITH {_HITS} SELECT count(*) AS hits, count(DISTINCT doc_id || ':' || line_no // 4) AS places, count(DISTINCT doc_id) AS files FROM hits""")
def hit_counts(t):
    h = _hits(t).groupBy("doc_id", F.expr("line_no div 4").alias("place")).agg(F.count("*").alias("n"))
    return h.agg(F.sum("n").alias("hits"), F.count("*").alias("places"), F.count_distinct("doc_id").alias("files"))


@query("SELECT count(*) AS files, sum(l_linenumber * 3)::BIGINT AS added, sum(l_quantity::BIGINT)::BIGINT AS removed FROM lineitem")
def churn_totals(t):
    return t("lineitem").agg(F.count("*").alias("files"), F.sum(F.col("l_linenumber") * 3).cast("long").alias("added"), F.sum(F.col("l_quantity").cast("long")).alias("removed"))


@query("""SELECT user_id, count(*) AS problems, count(*) FILTER (event_type = 'error') AS errors, min(event_id) AS first FROM events GROUP BY 1""")
def problems_by_file(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("problems"), F.count_if(F.col("event_type") == "error").alias("errors"), F.min("event_id").alias("first"))


# Logs as tools write them, a log a user: what each event would have been, by its number; read back, they must give the
# columns that they were made of.
_SAID = "SELECT event_id AS i, user_id AS log_id, event_id % 12 AS form, (event_id % 90 + 1) AS l, (event_id % 7 + 1) AS c, 'value ' || event_id || ' is off' AS m FROM events"


@query(f"""WITH s AS ({_SAID}) SELECT log_id, source, CASE WHEN form IN (2, 10) THEN 'warning' ELSE 'error' END AS severity, file, CASE WHEN form IN (5, 8, 11) THEN NULL ELSE l END AS line,
CASE WHEN form IN (4, 5, 8, 11) THEN NULL ELSE c END AS col, code, CASE WHEN form = 8 THEN 'test failed: Test' || i ELSE m END AS message, count(*) OVER (PARTITION BY log_id) AS problems FROM (SELECT *,
['tsc', 'tsc', 'eslint', 'cargo', 'python', 'pytest', 'jest', 'go', 'go', 'maven', 'generic', 'generic'][form + 1] AS source,
['src/m' || i || '.ts', 'src/p' || i || '.tsx', '/src/e' || i || '.js', 'lib/r' || i || '.rs', 'app/q' || i || '.py', 'tests/t' || i || '.py', 'web/j' || i || '.test.ts', 'srv/g' || i || '.go', NULL, '/w/A' || i || '.java', 'c/f' || i || '.c', NULL][form + 1] AS file,
['TS' || i, 'TS' || i, 'no-' || i, 'E' || i, 'ValueError', 'test_' || i, NULL, NULL, 'Test' || i, NULL, NULL, NULL][form + 1] AS code FROM s)""")
def log_diagnostics(t):
    forms = [
        "src/m{i}.ts({l},{c}): error TS{i}: {m}",
        "src/p{i}.tsx:{l}:{c} - error TS{i}: {m}",
        "/src/e{i}.js\n  {l}:{c}  warning  {m}  no-{i}\n",
        "error[E{i}]: {m}\n   |\n  --> lib/r{i}.rs:{l}:{c}",
        'Traceback (most recent call last):\n  File "app/q{i}.py", line {l}, in main\n  File "/usr/lib/python3/site-packages/x.py", line 3, in f\nValueError: {m}\nKeyError: no more',
        "FAILED tests/t{i}.py::test_{i} - {m}",
        "  ● {m}\n\n    at inner (node_modules/x.js:1:1)\n    at Object.<anonymous> (web/j{i}.test.ts:{l}:{c})",
        "./srv/g{i}.go:{l}:{c}: {m}",
        "--- FAIL: Test{i} (0.01s)",
        "[ERROR] /w/A{i}.java:[{l},{c}] {m}",
        "c/f{i}.c:{l}:{c}: warning: {m}",
        "x Error: {m}",
    ]
    # A form is filled in by replacing: joining all twelve from parts is more code than the JVM compiles.
    said = F.get(F.array(*[F.lit(x.replace("{m}", "value {i} is off")) for x in forms]), (F.col("event_id") % 12).cast("int"))
    for name, value in {"{i}": "event_id", "{l}": "event_id % 90 + 1", "{c}": "event_id % 7 + 1"}.items():
        said = F.replace(said, F.lit(name), F.expr(value).cast("string"))
    log = t("events").select(F.col("user_id").alias("log_id"), "event_id", F.posexplode(F.split(said, "\n")).alias("k", "text")).select("log_id", (F.col("event_id") * 8 + F.col("k")).alias("line_no"), "text")
    found = logs.diagnostics(log).withColumn("problems", F.count("*").over(Window.partitionBy("log_id")))
    return found.select("log_id", "source", "severity", "file", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), "code", "message", "problems")


_DIFFED = "SELECT l_orderkey AS log_id, l_linenumber AS n, l_linenumber % 4 AS kind, min(l_quantity::BIGINT) % 4 + 1 AS more, (min(l_partkey) % 3)::BIGINT AS less, (min(l_suppkey) % 50 + 1)::BIGINT AS low, 'd/f' || l_linenumber || '.txt' AS path FROM lineitem GROUP BY ALL"


@query(f"""WITH d AS ({_DIFFED}) SELECT log_id, path, CASE kind WHEN 0 THEN 'modified' WHEN 1 THEN 'added' WHEN 2 THEN 'deleted' ELSE 'renamed' END AS status, CASE WHEN kind = 3 THEN 'old/f' || n || '.txt' END AS previous,
CASE kind WHEN 2 THEN '1-1' ELSE low || '-' || (low + more - 1) || CASE WHEN kind = 0 THEN ',' || (low + 90) || '-' || (low + 90) ELSE '' END END AS ranges, CASE kind WHEN 2 THEN 0 WHEN 0 THEN more + 1 ELSE more END AS added, CASE kind WHEN 1 THEN 0 WHEN 2 THEN less + 1 ELSE less END AS removed FROM d""")
def diff_changes(t):
    """Diffs of orders, a file a line item: changed in two places, new, gone, or under another name."""
    # Dealt by log while a line item is one row still, so that the many lines made of it need not move.
    parts = int(t("lineitem").sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey").repartition(parts, "l_orderkey")
    one = items.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_quantity").cast("bigint")).alias("l_quantity"), F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    d = one.selectExpr("l_orderkey as log_id", "l_linenumber as n", "l_linenumber % 4 as kind", "cast(l_quantity % 4 + 1 as int) as more", "cast(l_partkey % 3 as int) as less", "cast(l_suppkey % 50 + 1 as int) as at", "concat('d/f', l_linenumber, '.txt') as path")
    old = F.when(F.col("kind") == 3, F.concat(F.lit("old/f"), "n", F.lit(".txt"))).otherwise(F.col("path"))
    rows = lambda text, n: F.array_repeat(F.lit(text), n)
    kind, gone = F.col("kind"), F.col("less") + F.when(F.col("kind") == 2, 1).otherwise(0)
    heads = F.array(F.concat(F.lit("diff --git a/"), old, F.lit(" b/"), "path"), F.when(kind == 1, F.lit("--- /dev/null")).otherwise(F.concat(F.lit("--- a/"), old)), F.when(kind == 2, F.lit("+++ /dev/null")).otherwise(F.concat(F.lit("+++ b/"), "path")))
    hunk = F.when(kind == 2, F.concat(F.lit("@@ -1,"), gone, F.lit(" +0,0 @@"))).otherwise(F.concat(F.lit("@@ -"), "at", F.lit(","), "less", F.lit(" +"), "at", F.lit(","), "more", F.lit(" @@ f()")))
    body = F.concat(F.array(hunk), rows("-was", F.when(kind == 1, 0).otherwise(gone)), rows("+is", F.when(kind == 2, 0).otherwise(F.col("more"))))
    again = F.when(kind == 0, F.array(F.concat(F.lit("@@ -7,0 +"), F.col("at") + 90, F.lit(" @@")), F.lit("+one"))).otherwise(F.array().cast("array<string>"))
    lines = d.select("log_id", "n", F.posexplode(F.concat(heads, body, again)).alias("k", "text"))
    found = logs.changes(lines.select("log_id", (F.col("n") * 100 + F.col("k")).alias("line_no"), "text"))
    ranges = F.array_join(F.transform("ranges", lambda r: F.concat(r["from"], F.lit("-"), r["to"])), ",")
    return found.select("log_id", "path", "status", "previous", ranges.alias("ranges"), "added", "removed")


@query("""SELECT c_nationkey::BIGINT AS log_id, 'c/' || c_custkey AS path, 'untracked' AS status FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0""")
def status_untracked(t):
    """Customers as a status listing: one in three unknown, of which every odd one is in the diff as well."""
    c = t("customer").select(F.col("c_nationkey").cast("long").alias("log_id"), "c_custkey", F.concat(F.lit("c/"), "c_custkey").alias("path"))
    lines = c.select("log_id", F.col("c_custkey").alias("line_no"), F.concat(F.when(F.col("c_custkey") % 3 == 0, "?? ").otherwise(" M "), "path").alias("text"))
    return logs.untracked(lines, c.where("c_custkey % 2 = 1").select("log_id", "path"))


@query("""SELECT n_regionkey::BIGINT AS log_id, list_extract(['origin/main', 'origin/master', 'main', 'master', 'origin/develop', 'develop'], min(n_nationkey % 7 + 1)::INT) AS base FROM nation WHERE n_nationkey % 7 < 6 AND n_regionkey > 0 GROUP BY 1""")
def default_branch(t):
    names = F.get(F.array(*map(F.lit, [*logs.BASES, "feature/x"])), (F.col("n_nationkey") % 7).cast("int"))
    rows = t("nation").where("n_regionkey > 0").select(F.col("n_regionkey").cast("long").alias("log_id"), F.col("n_nationkey").alias("line_no"), F.concat(F.lit("  "), names).alias("text"))
    return logs.default_base(rows)
