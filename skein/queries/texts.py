"""Queries of scalar text functions and keyword search."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text
from skein.graph import Graph
from skein.operators import search
from skein.queries.relational import GRAPH_SQL
from skein.sources.relational import read, relational_graph


def text_ids(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select(
        "p_partkey", text.make_id(F.col("p_brand"), F.lit("..x"), F.col("p_name")).alias("id"), text.norm(F.col("p_name")).alias("norm"),
        text.norm_label(F.col("p_type")).alias("norm_label"), F.array_join(text.search_tokens(F.concat_ws("Type.", "p_brand", "p_name")), " ").alias("tokens"),
        F.array_join(F.sort_array(text.shingles(F.col("p_name"))), "|").alias("shingles"), F.round(text.entropy(F.col("p_name")), 6).alias("entropy"),
        text.sanitize_filename(F.concat(F.lit("https://x.y/"), "p_name")).alias("file"),
    )


def page_text(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    plain = text.html_to_text(F.col("html"))
    return p.select(
        "page_id", text.extract_between(F.col("html"), "<title>", "</title>").alias("title"), F.length(plain).alias("n_chars"), F.md5(plain).alias("digest"),
        text.is_safe_url(F.col("url")).alias("safe"),
    )


def token_estimates(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", text.token_estimate(F.col("text")).cast("long").alias("tokens"), F.sha2("text", 256).alias("content_hash"))


def escaped_labels(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", text.sanitize_label(F.col("text")).alias("label"))


def _parts(spark, sf_dir) -> Graph:
    g = relational_graph(spark, sf_dir)
    return Graph(g.nodes.where("source_file = 'part'"), g.edges.where("relation = 'supplied_by'"))


def search_parts(spark, sf_dir):
    return search.search(_parts(spark, sf_dir), ["steel", "bra", "part"], 20).select("id", F.round("score", 6).alias("score"))


def community_members(spark, sf_dir):
    return search.community_members(relational_graph(spark, sf_dir), 2, 20, 5)


def resolve_label(spark, sf_dir):
    return search.resolve_label(relational_graph(spark, sf_dir), "a", 20)


def explain_node(spark, sf_dir):
    return search.explain(relational_graph(spark, sf_dir), "n:3")


def query_graph(spark, sf_dir):
    return search.query_graph(relational_graph(spark, sf_dir), "which suppliers in the ASIA region", budget=200)


def explore(spark, sf_dir):
    return search.explore(relational_graph(spark, sf_dir), "ASIA region suppliers")


def glob_matches(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    path = F.concat(F.lit("src/"), F.replace("p_brand", F.lit("#"), F.lit("/")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".rs"))
    hit = lambda pattern: path.rlike(text.glob_regex(pattern)).alias
    return p.select("p_partkey", hit("src/*/1*/b*.rs")("star"), hit("src/**/*_?olt.rs")("deep"), hit("src/*.rs")("flat"))


QUERIES = {
    "glob_matches": glob_matches,
    "text_ids": text_ids,
    "page_text": page_text,
    "token_estimates": token_estimates,
    "escaped_labels": escaped_labels,
    "search_parts": search_parts,
    "community_members": community_members,
    "resolve_label": resolve_label,
    "explain_node": explain_node,
    "query_graph": query_graph,
    "explore": explore,
}



def _tokens_sql(x: str) -> str:
    return r"list_filter(regexp_split_to_array(lower(regexp_replace(@, '([^\p{Lu}_.:/\\\s-])(\p{Lu})', '\1 \2', 'g')), '[_.:/\\\s-]+'), lambda t: t <> '')".replace("@", x)


def _found_sql(words: list[str]) -> str:
    """Search hits of all nodes, and what two steps from the best five reach."""
    asked = ", ".join(f"'{w}'" for w in words)
    return GRAPH_SQL.replace("WITH nodes", "WITH RECURSIVE nodes") + """
, n AS MATERIALIZED (SELECT id, label, source_file, CASE WHEN node_type IN ('module', 'package', 'namespace') THEN 0.35 WHEN node_type = 'file' THEN 0.7 ELSE 1.0 END AS kind, 0.1 * ln(1 + degree) AS boost FROM nodes JOIN degree USING (id))
, t AS (SELECT id, kind, boost, """ + _tokens_sql("label") + " AS tl, " + _tokens_sql("id") + " AS ti, " + _tokens_sql("source_file") + """ AS tf FROM n)
, post AS (SELECT id, unnest(tl) AS token, (2 / sqrt(len(tl)) + boost) * kind AS w FROM t UNION ALL SELECT id, unnest(ti), (1 + boost) * kind FROM t UNION ALL SELECT id, unnest(tf), (0.5 + boost) * kind FROM t)
, seeds AS MATERIALIZED (SELECT id FROM post JOIN (SELECT unnest([""" + asked + """]) AS q) ON starts_with(token, q) GROUP BY id ORDER BY round(sum(w * CASE WHEN token = q THEN 1.0 ELSE 0.5 END), 9) DESC, id LIMIT 5)
, steps AS MATERIALIZED (SELECT DISTINCT id, other FROM und)
, b(id, depth) AS (SELECT id, 0 FROM seeds UNION SELECT other, depth + 1 FROM b JOIN steps ON b.id = steps.id WHERE depth < 2)
, near AS (SELECT id, min(depth) AS depth FROM b GROUP BY id)
"""


ORACLES = {
    "glob_matches": r"""
WITH p AS (SELECT p_partkey, 'src/' || replace(p_brand, '#', '/') || '/' || replace(p_name, ' ', '_') || '.rs' AS path FROM part)
SELECT p_partkey, regexp_matches(path, '^src/[^/]*/1[^/]*/b[^/]*\.rs$') AS star, regexp_matches(path, '^src/(.*/)?[^/]*_[^/]olt\.rs$') AS deep, regexp_matches(path, '^src/[^/]*\.rs$') AS flat FROM p""",
    "query_graph": _found_sql(["which", "suppliers", "the", "asia", "region"]) + """
, r AS (SELECT near.id, depth, label, node_type, source_file, coalesce(sum(length(label)) OVER (ORDER BY depth, near.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM near JOIN nodes USING (id))
SELECT id, depth, label, node_type, source_file FROM r WHERE before < 800""",
    "explore": _found_sql(["asia", "region", "suppliers"]) + """
, f AS (SELECT source_file, count(*) AS symbols FROM near JOIN nodes USING (id) WHERE source_file <> '' GROUP BY source_file ORDER BY symbols DESC, source_file LIMIT 15)
, r AS (SELECT *, coalesce(sum(length(source_file) + 100 * symbols) OVER (ORDER BY symbols DESC, source_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM f)
SELECT source_file, symbols FROM r WHERE spent < 16000""",
    "text_ids": r"""
SELECT p_partkey, lower(trim(regexp_replace(concat_ws('_', trim(p_brand, '_.'), 'x', trim(p_name, '_.')), '[^\p{L}\p{N}]+', '_', 'g'), '_')) AS id,
       trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm, lower(p_type) AS norm_label,
       array_to_string(""" + _tokens_sql("p_brand || 'Type.' || p_name") + r""", ' ') AS tokens,
       array_to_string(list_sort(list_distinct(list_transform(range(1, greatest(length(replace(p_name, ' ', '')) - 2, 1) + 1), lambda i: substring(replace(p_name, ' ', ''), i, 3)))), '|') AS shingles,
       round(list_sum(list_transform(list_distinct(string_split(p_name, '')), lambda c: -(len(list_filter(string_split(p_name, ''), lambda x: x = c)) / length(p_name)) * log2(len(list_filter(string_split(p_name, ''), lambda x: x = c)) / length(p_name)))), 6) AS entropy,
       left(regexp_replace(translate('x.y/' || p_name, '/?&=# ', '______'), '[^\p{L}\p{N}_.-]', '', 'g'), 80) AS file
FROM part""",
    "page_text": r"""
WITH t AS (SELECT page_id, url, html, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'),
  '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS plain FROM pages)
SELECT page_id, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title, length(plain)::INT AS n_chars, md5(plain) AS digest,
       regexp_matches(url, '^https?://[a-z0-9.-]*[a-z][a-z0-9.-]*') AS safe FROM t""",
    "token_estimates": "SELECT doc_id, ceil(octet_length(encode(text)) / 4)::BIGINT AS tokens, sha256(text) AS content_hash FROM documents",
    "escaped_labels": r"""
SELECT doc_id, replace(replace(replace(replace(replace(left(regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g'), 256), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS label FROM documents""",
    "search_parts": """
WITH d AS (SELECT l_partkey AS k, count(*) AS degree FROM lineitem GROUP BY 1),
 n AS (SELECT 'p:' || p_partkey AS id, p_name AS label, coalesce(degree, 0) AS degree FROM part LEFT JOIN d ON p_partkey = k),
 t AS (SELECT id, degree, """ + _tokens_sql("label") + """ AS tl, """ + _tokens_sql("id") + """ AS ti FROM n),
 p AS (SELECT id, unnest(tl) AS token, 2 / sqrt(len(tl)) + 0.1 * ln(1 + degree) AS w FROM t
       UNION ALL SELECT id, unnest(ti), 1 + 0.1 * ln(1 + degree) FROM t UNION ALL SELECT id, 'part', 0.5 + 0.1 * ln(1 + degree) FROM t),
 q AS (SELECT unnest(['steel', 'bra', 'part']) AS q)
SELECT id, round(sum(w * CASE WHEN token = q THEN 1 ELSE 0.5 END), 6) AS score FROM p JOIN q ON starts_with(token, q) GROUP BY id ORDER BY round(sum(w * CASE WHEN token = q THEN 1 ELSE 0.5 END), 9) DESC, id LIMIT 20""",
    "community_members": GRAPH_SQL + "SELECT id, label, degree FROM nodes JOIN degree USING (id) WHERE community = 2 ORDER BY degree DESC, id LIMIT 20 OFFSET 5",
    "resolve_label": GRAPH_SQL + """
SELECT id, label, CASE WHEN id = 'a' THEN 3 WHEN lower(label) = 'a' THEN 2 ELSE 1 END AS tier, 1 AS is_symbol, degree FROM nodes JOIN degree USING (id)
WHERE id = 'a' OR contains(lower(label), 'a') ORDER BY tier DESC, degree DESC, id LIMIT 20""",
    "explain_node": GRAPH_SQL + """
, r AS (SELECT 'out' AS direction, relation, target AS id FROM edges WHERE source = 'n:3' UNION ALL SELECT 'in', relation, source FROM edges WHERE target = 'n:3'),
  k AS (SELECT direction, relation, label, row_number() OVER (PARTITION BY direction, relation ORDER BY label, r.id) AS rn FROM r JOIN nodes USING (id))
SELECT direction, relation, count(*) AS n, string_agg(label, ', ' ORDER BY label) FILTER (WHERE rn <= 15) AS labels FROM k GROUP BY 1, 2""",
}
