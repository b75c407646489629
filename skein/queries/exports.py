"""Queries of the text formats and drawing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.queries.relational import GRAPH_SQL
from skein.sinks import formats
from skein.sources.relational import read, relational_graph


def vis_nodes(spark, sf_dir):
    return formats.vis_nodes(relational_graph(spark, sf_dir)).select("id", "label", "degree", "size", "font_size")


def display_ids(spark, sf_dir):
    return formats.prune_for_display(relational_graph(spark, sf_dir), 100)


def svg_layout(spark, sf_dir):
    return formats.svg_layout(relational_graph(spark, sf_dir).nodes.where("source_file in ('nation', 'region')").select("id"))


def cypher_lines(spark, sf_dir):
    return formats.cypher(relational_graph(spark, sf_dir))


def turtle_lines(spark, sf_dir):
    return formats.turtle(relational_graph(spark, sf_dir)).select("line")


def graphml_lines(spark, sf_dir):
    return formats.graphml(relational_graph(spark, sf_dir))


def variable_names(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.concat(F.regexp_replace("p_name", " ", F.when(F.expr("p_partkey % 2 = 0"), "-").otherwise(".")), F.lit("")).alias("id")).distinct()
    return formats.variable_names(p)


def tree_overflow(spark, sf_dir):
    return formats.tree_rows(relational_graph(spark, sf_dir), 20).groupBy("community", "source_file", "kind").agg(F.count(F.lit(1)).alias("n"))


def node_link_rows(spark, sf_dir):
    return formats.node_link_rows(relational_graph(spark, sf_dir), compatible=True).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def wiki_pages(spark, sf_dir):
    return formats.wiki_pages(relational_graph(spark, sf_dir)).select("name")


def redis_script(spark, sf_dir):
    return formats.redis_script(relational_graph(spark, sf_dir))


def community_pages(spark, sf_dir):
    return formats.community_pages(relational_graph(spark, sf_dir))


QUERIES = {
    "redis_script": redis_script,
    "community_pages": community_pages,
    "vis_nodes": vis_nodes,
    "display_ids": display_ids,
    "svg_layout": svg_layout,
    "cypher_lines": cypher_lines,
    "turtle_lines": turtle_lines,
    "graphml_lines": graphml_lines,
    "variable_names": variable_names,
    "tree_overflow": tree_overflow,
    "node_link_rows": node_link_rows,
    "wiki_pages": wiki_pages,
}

_BACK = GRAPH_SQL + """
, bn AS (SELECT * FROM nodes), be AS (SELECT * FROM edges), bd AS (SELECT * FROM degree)
"""
_VAR = "regexp_replace(id, '[^A-Za-z0-9_]', '_', 'g')"

ORACLES = {
    "redis_script": _BACK + """
SELECT 0 AS part, 'GRAPH.QUERY skein "MERGE (n:' || upper(left(node_type, 1)) || substr(node_type, 2) || ' {id: ''' || id || '''}) SET n.label = ''' || label || '''"' AS line FROM bn
UNION ALL SELECT 1, 'GRAPH.QUERY skein "MATCH (a {id: ''' || source || '''}), (b {id: ''' || target || '''}) MERGE (a)-[:' || upper(relation) || ']->(b)"' FROM be""",
    "community_pages": _BACK + """
, c AS (SELECT id, community FROM bn WHERE community IS NOT NULL)
, e AS (SELECT a.community AS x, b.community AS y, source, target FROM be JOIN c a ON a.id = source JOIN c b ON b.id = target)
SELECT 'community_' || community AS page, 0 AS part, id AS a, NULL AS b, degree AS n FROM c JOIN bd USING (id)
UNION ALL SELECT 'community_' || x, 1, source, target, count(*) FROM e WHERE x = y GROUP BY x, source, target
UNION ALL SELECT 'overview', 0, 'community_' || community, NULL, count(*) FROM c GROUP BY community
UNION ALL SELECT 'overview', 1, 'community_' || least(x, y), 'community_' || greatest(x, y), count(*) FROM e WHERE x <> y GROUP BY least(x, y), greatest(x, y)""",
    "vis_nodes": _BACK + """
SELECT id, label, degree, round(10 + 30 * (degree / (SELECT max(degree) FROM bd)), 6) AS size, CASE WHEN degree / (SELECT max(degree) FROM bd) >= 0.15 THEN 12 ELSE 0 END AS font_size FROM bn JOIN bd USING (id)""",
    "display_ids": _BACK + """
, r AS (SELECT arg_min(id, (-degree, id)) AS id FROM bn JOIN bd USING (id) GROUP BY community)
SELECT id FROM r UNION ALL (SELECT id FROM bd WHERE id NOT IN (SELECT id FROM r) ORDER BY degree DESC, id LIMIT 100 - (SELECT count(*) FROM r))""",
    "svg_layout": _BACK + """
, i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM bn WHERE source_file IN ('nation', 'region'))
SELECT id, round(600 + 390 * cos(2 * pi() * i / n - pi() / 2), 6) AS x, round(450 + 390 * sin(2 * pi() * i / n - pi() / 2), 6) AS y FROM i""",
    "cypher_lines": _BACK + f"""
SELECT 0 AS part, 'MERGE (' || {_VAR} || ':' || upper(left(node_type, 1)) || substr(node_type, 2) || ' {{id: ''' || id || '''}}) SET ' || {_VAR} || '.label = ''' || replace(label, '''', '\\''') || ''';' AS line FROM bn
UNION ALL SELECT 1, 'MATCH (a {{id: ''' || source || '''}}), (b {{id: ''' || target || '''}}) MERGE (a)-[:' || upper(relation) || ']->(b);' FROM be""",
    "turtle_lines": _BACK + """
SELECT '<urn:graph:' || replace(id, ':', '%3A') || '> rdfs:label "' || label || '" .' AS line FROM bn
UNION SELECT '<urn:graph:' || replace(source, ':', '%3A') || '> <urn:graph:rel/' || relation || '> <urn:graph:' || replace(target, ':', '%3A') || '> .' FROM be""",
    "graphml_lines": _BACK + """
SELECT 0 AS part, '<node id="' || id || '"><data key="label">' || replace(label, '''', '&#39;') || '</data><data key="type">' || node_type || '</data><data key="file">' || source_file || '</data></node>' AS line FROM bn
UNION ALL SELECT 1, '<edge source="' || source || '" target="' || target || '"><data key="relation">' || relation || '</data><data key="confidence">' || confidence || '</data><data key="weight">' || weight || '</data></edge>' FROM be""",
    "variable_names": """
WITH i AS (SELECT DISTINCT replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '.' END) AS id FROM part), b AS (SELECT id, regexp_replace(id, '[^A-Za-z0-9_]', '_', 'g') AS base FROM i)
SELECT id, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '_' || (row_number() OVER (PARTITION BY base ORDER BY id) - 1) ELSE base END AS name FROM b""",
    "tree_overflow": _BACK + """
, c AS (SELECT community, source_file, count(*) AS k FROM bn GROUP BY 1, 2)
SELECT community, source_file, 'symbol' AS kind, least(k, 20) AS n FROM c UNION ALL SELECT community, source_file, 'overflow', 1 FROM c WHERE k > 20""",
    "node_link_rows": GRAPH_SQL + "SELECT 0 AS part, count(*) AS n FROM nodes UNION ALL SELECT 1, count(*) FROM edges",
    "wiki_pages": _BACK + """
SELECT DISTINCT 'community_' || community AS name FROM bn UNION ALL
SELECT 'node_' || replace(id, ':', '_') FROM bd WHERE degree >= (SELECT greatest(floor(2 * avg(degree)), 3) FROM bd)""",
}
