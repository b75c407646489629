"""Queries on the relational graph: analysis, building, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.graph import Graph
from skein.operators import analyze, build
from skein.sources.relational import read, relational_graph

#: The graph in SQL: ``nodes`` and ``edges`` of skein.sources.relational.
GRAPH_SQL = """
WITH nodes AS (
  SELECT 'r:' || r_regionkey AS id, r_name AS label, 'namespace' AS node_type, 'region' AS source_file, r_regionkey::BIGINT AS community FROM region
  UNION ALL SELECT 'n:' || n_nationkey, n_name, 'package', 'nation', n_regionkey FROM nation
  UNION ALL SELECT 'c:' || c_custkey, c_name, 'class', 'customer', n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 's:' || s_suppkey, s_name, 'interface', 'supplier', n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'p:' || p_partkey, p_name, 'struct', 'part', p_partkey % 5 FROM part
  UNION ALL SELECT 'o:' || o_orderkey, 'order ' || o_orderkey, 'function', 'orders', n_regionkey
            FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
), edges AS (
  SELECT *, CASE confidence WHEN 'EXTRACTED' THEN 1.0 WHEN 'INFERRED' THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence_score FROM (
  SELECT 'n:' || n_nationkey AS source, 'r:' || n_regionkey AS target, 'in_region' AS relation, 'EXTRACTED' AS confidence, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'in_nation', 'EXTRACTED', 1.0 FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'in_nation', 'EXTRACTED', 1.0 FROM supplier
  UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'placed_by', 'EXTRACTED', 1.0 FROM orders
  UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey, 'contains', CASE l_returnflag WHEN 'A' THEN 'EXTRACTED' WHEN 'N' THEN 'INFERRED' ELSE 'AMBIGUOUS' END, l_quantity FROM lineitem
  UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey, 'supplied_by', CASE l_returnflag WHEN 'A' THEN 'EXTRACTED' WHEN 'N' THEN 'INFERRED' ELSE 'AMBIGUOUS' END, l_quantity FROM lineitem)
), und AS (
  SELECT source AS id, target AS other, relation, confidence, weight FROM edges UNION ALL SELECT target, source, relation, confidence, weight FROM edges
), degree AS (
  SELECT n.id, count(u.id) AS degree FROM nodes n LEFT JOIN und u USING (id) GROUP BY n.id
)
"""

CUT = "1996-01-01"


def _dated(spark, sf_dir, late: bool) -> Graph:
    """The order part of the graph, up to a date or in full."""
    g = relational_graph(spark, sf_dir)
    old = read(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(CUT).cast("timestamp"))
    ids = old.select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"))
    nodes = g.nodes.where("source_file in ('orders', 'customer')")
    edges = g.edges.where("relation = 'placed_by'")
    if late:
        return Graph(nodes, edges)
    keep = nodes.where("source_file = 'customer'").unionByName(nodes.where("source_file = 'orders'").join(ids, "id", "left_semi"))
    return Graph(keep, edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select(*edges.columns))


def _merge(spark, sf_dir):
    g = relational_graph(spark, sf_dir)
    a = Graph(g.nodes.where("source_file in ('customer', 'nation')"), g.edges.where("relation = 'in_nation'"))
    b = Graph(
        g.nodes.where("source_file in ('customer', 'region', 'nation')").withColumn("label", F.upper("label")),
        g.edges.where("relation in ('in_nation', 'in_region')").withColumn("confidence_score", F.lit(0.5)),
    )
    return build.merge_graphs([("a", a), ("b", b)])


def merge_graphs(spark, sf_dir):
    g, _ = _merge(spark, sf_dir)
    return g.nodes.select("id", "label", "community")


def merge_graph_edges(spark, sf_dir):
    g, _ = _merge(spark, sf_dir)
    return g.edges.select("source", "target", "relation", "confidence_score")


def merge_stats(spark, sf_dir):
    return _merge(spark, sf_dir)[1]


def three_way_merge(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    ours = c.where("c_custkey % 10 <> 1").withColumn("c_name", F.when(F.expr("c_custkey % 4 = 0"), F.upper("c_name")).otherwise(F.col("c_name")))
    theirs = c.where("c_custkey % 15 <> 2").withColumn("c_mktsegment", F.when(F.expr("c_custkey % 6 = 0"), F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    base = c.where("c_custkey % 7 <> 3")
    return build.three_way(base, ours, theirs, ["c_custkey"])


def first_wins(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return build.first_wins(d.withColumn("h", F.sha2("text", 256)), ["h"], ["doc_id"]).select("doc_id", "h")


def dangling(spark, sf_dir):
    g = relational_graph(spark, sf_dir)
    part = g.nodes.where("source_file <> 'part' or pmod(cast(substring(id, 3) as bigint), 3) = 0")
    e = build.drop_dangling(part, g.edges.where("relation in ('contains', 'supplied_by')"))
    return e.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


def prune_repo(spark, sf_dir):
    g = relational_graph(spark, sf_dir)
    tagged = g.nodes.withColumn("extra", F.when(F.col("source_file") == "supplier", F.lit('{"repo":"x"}')))
    out = build.prune_repo(Graph(tagged, g.edges), "x")
    return out.edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def chunk_merge(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("role").alias("id"), F.col("conv_id").alias("_ord"), "turn", "text")
    even, odd = c.where("_ord % 2 = 0"), c.where("_ord % 2 = 1")
    merged = build.merge_chunks([Graph(x.select("id", "_ord", "turn", "text"), x.select("turn")) for x in (even, odd)])
    first = even.unionByName(odd)
    return merged.nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("_ord").alias("conv_id")).join(
        first.groupBy("id").agg(F.count(F.lit(1)).alias("seen")), "id"
    )


def on_graph(operator, *args, **kwargs):
    return lambda spark, sf_dir: operator(relational_graph(spark, sf_dir), *args, **kwargs)


def community_bridges(spark, sf_dir):
    b = analyze.community_bridges(relational_graph(spark, sf_dir))
    return b.select("id", "label", "community", "total_edges", "cross_edges", F.array_join("touched", ",").alias("touched"), F.round("bridge_ratio", 6).alias("bridge_ratio"))


def degree(spark, sf_dir):
    return relational_graph(spark, sf_dir).degree()


def graph_diff(spark, sf_dir):
    return build.graph_diff(_dated(spark, sf_dir, False), _dated(spark, sf_dir, True))


def diff_summary(spark, sf_dir):
    return build.diff_summary(_dated(spark, sf_dir, False), _dated(spark, sf_dir, True))


def _pages_graph(spark, sf_dir) -> Graph:
    """Pages as nodes under the path of their address; consecutive pages of a host are linked."""
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    n = p.select(F.concat(F.lit("w:"), F.col("page_id").cast("string")).alias("id"), F.col("path").alias("source_file"), F.col("path").alias("label"), F.lit(None).cast("long").alias("community"))
    e = p.select(F.concat(F.lit("w:"), F.col("page_id").cast("string")).alias("source"), F.concat(F.lit("w:"), (F.col("page_id") + 1).cast("string")).alias("target"))
    return Graph(n, e)


def directory_nodes(spark, sf_dir):
    return analyze.directory_nodes(_pages_graph(spark, sf_dir))


def directory_edges(spark, sf_dir):
    return analyze.directory_edges(_pages_graph(spark, sf_dir))


QUERIES = {
    "god_nodes": on_graph(analyze.god_nodes),
    "degree": degree,
    "graph_stats": on_graph(analyze.graph_stats),
    "type_counts": on_graph(analyze.type_counts),
    "relation_counts": on_graph(analyze.relation_counts),
    "confidence_breakdown": on_graph(analyze.confidence_breakdown),
    "surprising_connections": on_graph(analyze.surprising_connections, 20),
    "community_bridges": community_bridges,
    "cohesion": on_graph(analyze.cohesion, None),
    "cross_community": on_graph(analyze.cross_community),
    "representatives": on_graph(analyze.representatives),
    "isolated_share": on_graph(analyze.isolated_share),
    "directory_nodes": directory_nodes,
    "directory_edges": directory_edges,
    "graph_diff": graph_diff,
    "diff_summary": diff_summary,
    "merge_graphs": merge_graphs,
    "merge_graph_edges": merge_graph_edges,
    "merge_stats": merge_stats,
    "three_way_merge": three_way_merge,
    "first_wins": first_wins,
    "dangling": dangling,
    "prune_repo": prune_repo,
    "chunk_merge": chunk_merge,
}

_MERGE_SQL = GRAPH_SQL + """
, na AS (SELECT *, 0 AS i FROM nodes WHERE source_file IN ('customer', 'nation')
         UNION ALL SELECT id, upper(label), node_type, source_file, community, 1 FROM nodes WHERE source_file IN ('customer', 'region', 'nation'))
, ea AS (SELECT source, target, relation, confidence_score, 0 AS i FROM edges WHERE relation = 'in_nation'
         UNION ALL SELECT source, target, relation, 0.5, 1 FROM edges WHERE relation IN ('in_nation', 'in_region'))
, pairs AS (SELECT i, community, row_number() OVER (ORDER BY i, community) - 1 AS k FROM (SELECT DISTINCT i, community FROM na WHERE community IS NOT NULL))
, won AS (SELECT n.id, n.label, k AS community FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS rn FROM na) n LEFT JOIN pairs p ON n.i = p.i AND n.community = p.community WHERE rn = 1)
, kept AS (SELECT source, target, relation, max(confidence_score) AS confidence_score FROM ea GROUP BY 1, 2, 3)
, whole AS (SELECT * FROM kept WHERE source IN (SELECT id FROM won) AND target IN (SELECT id FROM won))
"""
_DIR = "CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END"
_PAGES = "WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages) "

_DIFF_SQL = f"""
WITH old AS (SELECT 'o:' || o_orderkey AS id, 'c:' || o_custkey AS c FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}'),
     new AS (SELECT 'o:' || o_orderkey AS id, 'c:' || o_custkey AS c FROM orders)
"""

ORACLES = {
    "god_nodes": GRAPH_SQL + """
SELECT row_number() OVER (ORDER BY degree DESC, id)::INT AS rank, id, label, degree, community FROM nodes JOIN degree USING (id)
WHERE NOT (source_file <> '' AND label = source_file) AND NOT (label LIKE '.%()') AND NOT (label LIKE '%()' AND degree <= 1)
ORDER BY degree DESC, id LIMIT 10""",
    "degree": GRAPH_SQL + "SELECT id, degree FROM degree",
    "graph_stats": GRAPH_SQL + """
SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(DISTINCT community) FROM nodes) AS community_count,
       (SELECT max(degree) FROM degree) AS max_degree, printf('%.2f', 2.0 * (SELECT count(*) FROM edges) / (SELECT count(*) FROM nodes)) AS avg_degree""",
    "type_counts": GRAPH_SQL + "SELECT node_type, count(*) AS n FROM nodes GROUP BY 1",
    "relation_counts": GRAPH_SQL + "SELECT relation, count(*) AS n FROM edges GROUP BY 1 ORDER BY n DESC, relation LIMIT 15",
    "confidence_breakdown": GRAPH_SQL + "SELECT confidence, count(*) AS n, printf('%.1f', 100.0 * count(*) / sum(count(*)) OVER ()) AS percent FROM edges GROUP BY 1",
    "surprising_connections": GRAPH_SQL + """
SELECT source, target, relation, confidence, (CASE WHEN coalesce(a.community, -1) <> coalesce(b.community, -1) THEN 2.0 ELSE 0 END
 + CASE WHEN a.source_file <> b.source_file THEN 1.0 ELSE 0 END + CASE confidence WHEN 'AMBIGUOUS' THEN 3.0 WHEN 'INFERRED' THEN 1.5 ELSE 0 END)::DOUBLE AS score
FROM edges JOIN nodes a ON source = a.id JOIN nodes b ON target = b.id WHERE score > 0 ORDER BY score DESC, source, target, relation LIMIT 20""",
    "community_bridges": GRAPH_SQL + """
SELECT a.id, a.label, a.community, count(*) AS total_edges, sum((b.community <> a.community)::BIGINT)::BIGINT AS cross_edges,
       array_to_string(list_sort(list_distinct(list_append(list(b.community), a.community))), ',') AS touched, round(sum((b.community <> a.community)::INT) / count(*), 6) AS bridge_ratio
FROM und JOIN nodes a ON und.id = a.id JOIN nodes b ON other = b.id
WHERE a.community IS NOT NULL AND b.community IS NOT NULL AND a.label <> a.source_file
GROUP BY a.id, a.label, a.community HAVING cross_edges > 0 ORDER BY sum((b.community <> a.community)::INT) / count(*) DESC, cross_edges DESC, a.id LIMIT 10""",
    "cohesion": GRAPH_SQL + """
SELECT s.community, s.size, coalesce(n, 0) AS internal_edges, CASE WHEN size <= 1 THEN 1.0 ELSE coalesce(n, 0) / (size * (size - 1) / 2) END AS cohesion
FROM (SELECT community, count(*) AS size FROM nodes WHERE community IS NOT NULL GROUP BY 1) s
LEFT JOIN (SELECT a.community, count(*) AS n FROM edges JOIN nodes a ON source = a.id JOIN nodes b ON target = b.id WHERE a.community = b.community GROUP BY 1) i USING (community)""",
    "cross_community": GRAPH_SQL + """
SELECT least(a.community, b.community) AS low, greatest(a.community, b.community) AS high, count(*) AS n FROM edges JOIN nodes a ON source = a.id JOIN nodes b ON target = b.id
WHERE a.community <> b.community GROUP BY 1, 2 ORDER BY n DESC, low, high LIMIT 20""",
    "representatives": GRAPH_SQL + """
SELECT community, size, id, label, degree FROM (SELECT n.*, degree, count(*) OVER (PARTITION BY community) AS size, row_number() OVER (PARTITION BY community ORDER BY degree DESC, n.id) AS rn
FROM nodes n JOIN degree USING (id) WHERE community IS NOT NULL) WHERE rn = 1""",
    "isolated_share": GRAPH_SQL + "SELECT count(*) AS nodes, sum((degree = 0)::BIGINT)::BIGINT AS isolated, (sum((degree = 0)::BIGINT) * 100 // count(*))::BIGINT AS percent FROM degree",
    "directory_nodes": _PAGES + f"SELECT {_DIR} AS dir, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, dir LIMIT 30",
    "directory_edges": _PAGES + f"""
, d AS (SELECT page_id, {_DIR} AS dir FROM p)
SELECT least(a.dir, b.dir) AS low, greatest(a.dir, b.dir) AS high, count(*) AS n FROM d a JOIN d b ON b.page_id = a.page_id + 1 WHERE a.dir <> b.dir GROUP BY 1, 2 ORDER BY n DESC, low, high LIMIT 20""",
    "graph_diff": _DIFF_SQL + """
SELECT 'node' AS kind, 'added' AS change, id AS source, NULL::VARCHAR AS target, NULL::VARCHAR AS relation FROM new WHERE id NOT IN (SELECT id FROM old)
UNION ALL SELECT 'edge', 'added', id, c, 'placed_by' FROM new WHERE id NOT IN (SELECT id FROM old)""",
    "diff_summary": _DIFF_SQL + """
SELECT n - o AS nodes_added, 0::BIGINT AS nodes_removed, n - o AS edges_added, 0::BIGINT AS edges_removed, c + o AS old_nodes, o AS old_edges, c + n AS new_nodes, n AS new_edges
FROM (SELECT (SELECT count(*) FROM old) AS o, (SELECT count(*) FROM new) AS n, (SELECT count(*) FROM customer) AS c)""",
    "merge_graphs": _MERGE_SQL + "SELECT id, label, community FROM won",
    "merge_graph_edges": _MERGE_SQL + "SELECT source, target, relation, confidence_score FROM whole",
    "merge_stats": _MERGE_SQL + """
SELECT (SELECT count(*) FROM na) AS nodes_in, (SELECT count(*) FROM won) AS nodes_out,
       (SELECT count(*) FROM (SELECT id FROM na GROUP BY id HAVING count(DISTINCT label) > 1)) AS node_conflicts,
       (SELECT count(*) FROM ea) AS edges_in, (SELECT count(*) FROM kept) AS edges_distinct, (SELECT count(*) FROM whole) AS edges_out""",
    "three_way_merge": """
WITH b AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 7 <> 3),
 o AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS c_name, c_mktsegment FROM customer WHERE c_custkey % 10 <> 1),
 t AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 6 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 15 <> 2),
 j AS (SELECT coalesce(o.c_custkey, t.c_custkey, b.c_custkey) AS k, o.c_custkey IS NOT NULL AS ho, t.c_custkey IS NOT NULL AS ht, b.c_custkey IS NOT NULL AS hb,
       o.c_name AS n1, o.c_mktsegment AS m1, t.c_name AS n2, t.c_mktsegment AS m2, (o.c_name, o.c_mktsegment) = (t.c_name, t.c_mktsegment) AS same,
       (o.c_name, o.c_mktsegment) = (b.c_name, b.c_mktsegment) AS o_is_b, (t.c_name, t.c_mktsegment) = (b.c_name, b.c_mktsegment) AS t_is_b
       FROM b FULL JOIN o ON b.c_custkey = o.c_custkey FULL JOIN t ON coalesce(o.c_custkey, b.c_custkey) = t.c_custkey),
 p AS (SELECT *, CASE WHEN ho AND ht AND same THEN 'o' WHEN ho AND ht AND hb AND o_is_b THEN 't' WHEN ho AND ht THEN 'o' WHEN ho AND NOT hb THEN 'o' WHEN ht AND NOT hb THEN 't' END AS w FROM j)
SELECT k AS c_custkey, CASE w WHEN 'o' THEN n1 ELSE n2 END AS c_name, CASE w WHEN 'o' THEN m1 ELSE m2 END AS c_mktsegment,
       (ho AND ht AND NOT same AND NOT (hb AND o_is_b) AND NOT (hb AND t_is_b)) AS _conflict FROM p WHERE w IS NOT NULL""",
    "first_wins": "SELECT min(doc_id) AS doc_id, h FROM (SELECT doc_id, sha256(text) AS h FROM documents) GROUP BY h",
    "dangling": """
SELECT 'contains' AS relation, count(*) AS n, sum(l_quantity) AS weight FROM lineitem WHERE l_partkey % 3 = 0
UNION ALL SELECT 'supplied_by', count(*), sum(l_quantity) FROM lineitem WHERE l_partkey % 3 = 0""",
    "prune_repo": GRAPH_SQL + "SELECT relation, count(*) AS n FROM edges WHERE source NOT LIKE 's:%' AND target NOT LIKE 's:%' GROUP BY 1",
    "chunk_merge": """
SELECT role AS id, 1::BIGINT AS n, (SELECT min(conv_id) FROM conversations c WHERE c.role = m.role AND conv_id % 2 = (SELECT min(conv_id % 2) FROM conversations c WHERE c.role = m.role)) AS conv_id, count(*) AS seen
FROM conversations m GROUP BY role""",
}
