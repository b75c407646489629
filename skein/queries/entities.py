"""Queries of entity resolution, outcomes, impact and communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.text import norm
from skein.graph import NODE_SCHEMA, Graph, complete
from skein.operators import cluster, outcomes, resolve
from skein.queries.relational import GRAPH_SQL
from skein.sources.relational import read, relational_graph

NOW = "2024-02-01"


def jaro_pairs(spark, sf_dir):
    """Names of parts with a key divisible by 50 against all names."""
    p = read(spark, sf_dir, "part")
    queries = p.where("p_partkey % 50 = 0").select(F.col("p_name").alias("x")).distinct()
    pairs = queries.join(p.select(F.col("p_name").alias("y")).distinct(), F.col("x") < F.col("y"))
    return pairs.select("x", "y", F.round(resolve.jaro_score("x", "y"), 6).alias("jaro"), F.round(resolve.jaro_winkler_score("x", "y"), 6).alias("winkler"))


def _entities(spark, sf_dir) -> Graph:
    d = read(spark, sf_dir, "documents")
    n = d.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.element_at(F.split("text", "\n"), 1).alias("label"), F.col("source").alias("source_file"),
        F.lit("concept").alias("node_type"), F.col("doc_id").alias("_ord"),
    )
    g = relational_graph(spark, sf_dir)
    return Graph(complete(n, NODE_SCHEMA), g.edges.limit(0))


def exact_merges(spark, sf_dir):
    return resolve.exact_groups(_entities(spark, sf_dir))


def resolve_entities(spark, sf_dir):
    return resolve.resolve_entities(_entities(spark, sf_dir))[1]


def resolution_counts(spark, sf_dir):
    return resolve.resolution_counts(_entities(spark, sf_dir))


def remapped_communities(spark, sf_dir):
    """Communities of customers by nation, remapped to their former ones by region and balance."""
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").cast("long").alias("nation"))
    old = c.select("id", F.expr("(nation * 7 + substring(id, 3) % 3) % 20").cast("long").alias("community"))
    return cluster.remap(c.select("id", F.col("nation").alias("community")), old).groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))


def cosine_pairs(spark, sf_dir):
    p = resolve.similar_pairs(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.3, 20)
    return p.select("a", "b", F.round("similarity", 6).alias("similarity"))


def _citations(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("event_type in ('purchase', 'error')")
    return e.select(F.col("user_id").alias("node"), F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("sign"), F.date_trunc("second", "ts").alias("ts"))


def decayed_scores(spark, sf_dir):
    s = outcomes.decayed_scores(_citations(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return s.select("node", F.round("score", 6).alias("score"), "positive", "negative", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"))


def lessons(spark, sf_dir):
    s = outcomes.decayed_scores(_citations(spark, sf_dir).where("node % 3 = 0 or sign > 0"), F.lit(NOW).cast("timestamp"))
    return outcomes.lessons(s, 10).select("node", "kind", F.round("score", 6).alias("score"), "positive", "negative")


def plurality(spark, sf_dir):
    return outcomes.plurality(read(spark, sf_dir, "events"), "user_id", "event_type")


def latest_turn(spark, sf_dir):
    return outcomes.latest(read(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


def _touched(spark, sf_dir):
    g = relational_graph(spark, sf_dir)
    files = g.nodes.where("source_file = 'part'").withColumn("source_file", F.concat(F.lit("src/"), F.expr("cast(substring(id, 3) as bigint) % 97"), F.lit("/"), F.expr("cast(substring(id, 3) as bigint) % 11"), F.lit(".rs")))
    line = read(spark, sf_dir, "lineitem")
    changes = line.select(F.expr("l_orderkey div 400").alias("change"), F.concat(F.expr("l_partkey % 97"), F.lit("/"), F.expr("l_partkey % 11"), F.lit(".rs")).alias("path")).distinct()
    return outcomes.impact(changes, outcomes.footprint(files))


def impact(spark, sf_dir):
    return _touched(spark, sf_dir).select("change", "n_nodes", F.array_join("communities", ",").alias("communities"))


def conflicts(spark, sf_dir):
    return outcomes.conflicts(_touched(spark, sf_dir)).select("community", "n", F.array_join("changes", ",").alias("changes"))


def communities(spark, sf_dir):
    return cluster.communities(relational_graph(spark, sf_dir))


def label_communities(spark, sf_dir):
    return cluster.label_communities(relational_graph(spark, sf_dir))


def heuristic_labels(spark, sf_dir):
    return cluster.heuristic_labels(relational_graph(spark, sf_dir))


def memo_hits(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    known = d.where("doc_id % 2 = 0").groupBy("h").agg(F.min("doc_id").alias("cached"))
    return d.where("doc_id % 2 = 1").join(known, "h", "left").select("doc_id", "cached", F.col("cached").isNotNull().alias("hit"))


QUERIES = {
    "jaro_pairs": jaro_pairs,
    "exact_merges": exact_merges,
    "resolve_entities": resolve_entities,
    "resolution_counts": resolution_counts,
    "remapped_communities": remapped_communities,
    "cosine_pairs": cosine_pairs,
    "decayed_scores": decayed_scores,
    "lessons": lessons,
    "plurality": plurality,
    "latest_turn": latest_turn,
    "impact": impact,
    "conflicts": conflicts,
    "communities": communities,
    "label_communities": label_communities,
    "heuristic_labels": heuristic_labels,
    "memo_hits": memo_hits,
}

_CITED = """
WITH c AS (SELECT user_id AS node, CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END AS sign, date_trunc('second', ts) AS ts FROM events WHERE event_type IN ('purchase', 'error')),
 s AS (SELECT node, sum(sign * pow(0.5, greatest(epoch(TIMESTAMP '2024-02-01') - epoch(ts), 0) / 86400.0 / 30)) AS score, count(*) FILTER (WHERE sign > 0) AS positive,
       count(*) FILTER (WHERE sign < 0) AS negative, max(ts) AS last FROM c {where} GROUP BY node)
"""
_TOUCH = """
WITH f AS (SELECT 'src/' || p_partkey % 97 || '/' || p_partkey % 11 || '.rs' AS file, p_partkey % 97 || '/' || p_partkey % 11 || '.rs' AS tail, count(*) AS n, list(DISTINCT p_partkey % 5) AS cs FROM part GROUP BY 1, 2),
 c AS (SELECT DISTINCT l_orderkey // 400 AS change, l_partkey % 97 || '/' || l_partkey % 11 || '.rs' AS path FROM lineitem),
 i AS (SELECT change, sum(n)::BIGINT AS n_nodes, list_sort(list_distinct(flatten(list(cs)))) AS cs FROM c JOIN f ON path = tail GROUP BY change)
"""

ORACLES = {
    "exact_merges": r"""
SELECT trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm, source AS source_file, arg_min('d' || doc_id, (length('d' || doc_id), 'd' || doc_id)) AS winner, count(*) AS n
FROM documents WHERE source <> '' GROUP BY 1, 2 HAVING n > 1 AND norm <> ''""",
    "cosine_pairs": """
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, 1, 2 LIMIT 20""",
    "decayed_scores": _CITED.format(where="") + "SELECT node, round(score, 6) AS score, positive, negative, strftime(last, '%Y-%m-%d %H:%M:%S') AS last FROM s",
    "lessons": _CITED.format(where="WHERE node % 3 = 0 OR sign > 0") + """
SELECT node, CASE WHEN positive > 0 AND negative > 0 THEN 'contested' WHEN positive >= 10 THEN 'preferred' ELSE 'tentative' END AS kind, round(score, 6) AS score, positive, negative FROM s WHERE positive > 0""",
    "plurality": """
SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1""",
    "latest_turn": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "impact": _TOUCH + "SELECT change, n_nodes, array_to_string(cs, ',') AS communities FROM i",
    "conflicts": _TOUCH + """
SELECT community, count(*) AS n, string_agg(change, ',' ORDER BY change) AS changes FROM (SELECT DISTINCT change, unnest(cs) AS community FROM i) GROUP BY community HAVING n > 1""",
    "heuristic_labels": GRAPH_SQL + """
, k AS (SELECT community, id, label, CASE WHEN label IN ('lib', 'super::*', 'main', 'mod', 'tests') OR contains(label, '::') THEN NULL
        WHEN node_type IN ('function', 'class', 'struct', 'trait', 'interface') THEN 0 WHEN node_type = 'module' THEN 2 WHEN node_type = 'file' THEN 3 ELSE 1 END AS r FROM nodes WHERE community IS NOT NULL)
, b AS (SELECT community, coalesce(arg_min(label, (r, label)) FILTER (WHERE r IS NOT NULL), arg_min(label, id)) AS label FROM k GROUP BY community)
SELECT community, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY community) > 1 THEN label || ' (' || community || ')' ELSE label END AS label FROM b""",
    "memo_hits": """
WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), k AS (SELECT h, min(doc_id) AS cached FROM d WHERE doc_id % 2 = 0 GROUP BY h)
SELECT doc_id, cached, cached IS NOT NULL AS hit FROM d LEFT JOIN k USING (h) WHERE doc_id % 2 = 1""",
}
