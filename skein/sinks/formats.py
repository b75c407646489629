"""Graphs as text formats.

Each function returns a DataFrame ``(part, line)``: lines are made by the
executors in columns; :func:`write_text` sorts by part and adds the fixed first
and last lines.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import cypher_escape, fnv_digest, html_escape, redis_escape, xml_escape, yaml_quote
from skein.graph import Graph

#: Relation names of the compatible interchange format.
RENAMED = {"defines": "contains", "imports": "imports_from"}


def node_link_rows(g: Graph, compatible: bool = False) -> DataFrame:
    """(part, line): one JSON object per node (part 0) and per edge (part 1)."""
    n = g.nodes.select("id", "label", "source_file", "source_location", "node_type", "community")
    e = g.edges.select("source", "target", "relation", "confidence", "confidence_score", "source_file", "source_location", "weight")
    if compatible:
        relation = F.col("relation")
        for old, new in RENAMED.items():
            relation = F.when(F.col("relation") == old, new).otherwise(relation)
        clean = lambda c: F.regexp_replace(c, r"^\./", "")
        n = n.withColumn("source_file", clean("source_file")).withColumn("norm_label", F.lower("label"))
        e = e.withColumn("relation", relation).withColumn("source_file", clean("source_file"))
    keep = {"ignoreNullFields": "false"} if compatible else {}
    return n.select(F.lit(0).alias("part"), F.to_json(F.struct(*n.columns), keep).alias("line")).unionAll(
        e.select(F.lit(1).alias("part"), F.to_json(F.struct(*e.columns), keep).alias("line"))
    )


def node_link_document(g: Graph, compatible: bool = False) -> str:
    """The single-document form, for graphs that fit the driver."""
    rows = node_link_rows(g, compatible).collect()
    nodes = [json.loads(r.line) for r in rows if r.part == 0]
    links = [json.loads(r.line) for r in rows if r.part == 1]
    return json.dumps({"directed": False, "multigraph": False, "graph": {}, "nodes": nodes, "links": links})


def graphml(g: Graph) -> DataFrame:
    data = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), xml_escape(c), F.lit("</data>"))
    n = g.nodes.select(
        F.lit(0).alias("part"),
        F.concat(F.lit('<node id="'), xml_escape(F.col("id")), F.lit('">'), data("label", F.col("label")), data("type", F.col("node_type")), data("file", F.col("source_file")), F.lit("</node>")).alias("line"),
    )
    e = g.edges.select(
        F.lit(1),
        F.concat(
            F.lit('<edge source="'), xml_escape(F.col("source")), F.lit('" target="'), xml_escape(F.col("target")), F.lit('">'),
            data("relation", F.col("relation")), data("confidence", F.col("confidence")), data("weight", F.col("weight").cast("string")), F.lit("</edge>"),
        ),
    )
    return n.unionAll(e)


GRAPHML_FRAME = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<graph edgedefault="undirected">',
    "</graph>\n</graphml>",
)


def variable_names(ids: DataFrame) -> DataFrame:
    """(id, name): identifiers without foreign characters; those that collide get ``_0``, ``_1``, ..."""
    base = F.regexp_replace("id", "[^A-Za-z0-9_]", "_")
    base = F.when(base.rlike("^[0-9]"), F.concat(F.lit("n"), base)).otherwise(base)
    n = ids.select("id", base.alias("base"))
    w = Window.partitionBy("base")
    many, nth = F.count(F.lit(1)).over(w) > 1, F.row_number().over(w.orderBy("id")) - 1
    return n.select("id", F.when(many, F.concat_ws("_", "base", nth)).otherwise(F.col("base")).alias("name"))


def cypher(g: Graph) -> DataFrame:
    """MERGE statements: nodes, then edges."""
    q = lambda c: F.concat(F.lit("'"), cypher_escape(c), F.lit("'"))
    kind = F.initcap("node_type")
    n = g.nodes.join(variable_names(g.nodes), "id").select(
        F.lit(0).alias("part"),
        F.concat(F.lit("MERGE ("), "name", F.lit(":"), kind, F.lit(" {id: "), q(F.col("id")), F.lit("}) SET "), "name", F.lit(".label = "), q(F.col("label")), F.lit(";")).alias("line"),
    )
    relation = F.upper(F.regexp_replace("relation", "[^A-Za-z0-9_]", "_"))
    e = g.edges.select(
        F.lit(1),
        F.concat(F.lit("MATCH (a {id: "), q(F.col("source")), F.lit("}), (b {id: "), q(F.col("target")), F.lit("}) MERGE (a)-[:"), relation, F.lit("]->(b);")),
    )
    return n.unionAll(e)


def percent_encode(text: Column) -> Column:
    """Every byte but letters, digits and ``-._~`` as %XX."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    coded = F.transform(chars, lambda c: F.when(c.rlike("^[A-Za-z0-9._~-]$"), c).otherwise(F.regexp_replace(F.hex(c.cast("binary")), "(..)", "%$1")))
    return F.array_join(coded, "")


def turtle(g: Graph, base: str = "urn:graph:") -> DataFrame:
    """RDF triples, repeated ones once."""
    iri = lambda c: F.concat(F.lit(f"<{base}"), percent_encode(c), F.lit(">"))
    literal = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r'(["\\])', r"\\$1"), "\n", r"\\n"), F.lit('"'))
    n = g.nodes.select(F.lit(0).alias("part"), F.concat(iri(F.col("id")), F.lit(" rdfs:label "), literal(F.col("label")), F.lit(" .")).alias("line"))
    e = g.edges.select(F.lit(1), F.concat(iri(F.col("source")), F.lit(f" <{base}rel/"), percent_encode(F.col("relation")), F.lit("> "), iri(F.col("target")), F.lit(" .")))
    return n.unionAll(e).distinct()


def vis_nodes(g: Graph) -> DataFrame:
    """(id, label, community, degree, size, font_size) of a drawn graph: size 10 + 30 * share of the largest degree."""
    d = g.nodes.join(g.degree(), "id")
    top = g.degree().agg(F.greatest(F.max("degree"), F.lit(1)).alias("top"))  # one row
    share = F.col("degree") / F.col("top")
    return d.crossJoin(top).select(
        "id", html_escape(F.col("label")).alias("label"), "community", "degree", F.round(10 + 30 * share, 6).alias("size"), F.when(share >= 0.15, 12).otherwise(0).alias("font_size")
    )


def prune_for_display(g: Graph, most: int = 2000) -> DataFrame:
    """Ids to draw: the most connected, and one of each community in up to a quarter of the places; 0 keeps all."""
    if most == 0:
        return g.nodes.select("id")
    d = g.nodes.join(g.degree(), "id").select("id", "community", "degree")
    n = g.nodes.where("community is not null").agg(F.count_distinct("community")).first()[0]
    slots = min(n, most // 4)
    best = d.where("community is not null").groupBy("community").agg(F.min(F.struct((-F.col("degree")).alias("d"), "id")).alias("b"))
    reps = best.orderBy("b.d", "b.id").limit(slots).select(F.col("b.id").alias("id"))
    rest = d.join(reps, "id", "left_anti").orderBy(F.desc("degree"), "id").limit(most - slots).select("id")
    return reps.unionAll(rest)


def svg_layout(ids: DataFrame, width: int = 1200, height: int = 900) -> DataFrame:
    """(id, x, y): places on a circle, in id order."""
    n = ids.count()
    i = F.row_number().over(Window.orderBy("id")) - 1  # what is drawn is small
    angle = 2 * F.pi() * i / max(n, 1) - F.pi() / 2
    r = min(width, height) / 2 - 60
    return ids.select("id", F.round(width / 2 + r * F.cos(angle), 6).alias("x"), F.round(height / 2 + r * F.sin(angle), 6).alias("y"))


def tree_rows(g: Graph, most_children: int = 200) -> DataFrame:
    """(community, source_file, label, kind): symbols under files under communities, with overflow rows."""
    n = g.nodes.select("community", "source_file", "id", "label")
    w = Window.partitionBy("community", "source_file")
    n = n.withColumn("rn", F.row_number().over(w.orderBy("label", "id"))).withColumn("n", F.count(F.lit(1)).over(w))
    rows = n.where(F.col("rn") <= most_children).select("community", "source_file", "label", F.lit("symbol").alias("kind"))
    more = n.where(F.col("rn") == most_children + 1).select("community", "source_file", F.format_string("(+%d more)", F.col("n") - most_children), F.lit("overflow"))
    return rows.unionAll(more)


def wiki_pages(g: Graph) -> DataFrame:
    """(name, text): a page per community, and per node of at least twice the mean degree (3 at least)."""
    d = g.nodes.join(g.degree(), "id")
    mean = g.degree().agg(F.greatest(F.floor(2 * F.avg("degree")), F.lit(3)).alias("least"))  # one row
    members = d.where("community is not null").groupBy("community").agg(F.sort_array(F.collect_list("label")).alias("m"))
    c = members.select(F.format_string("community_%d", "community").alias("name"), F.concat(F.format_string("# Community %d\n\n- ", "community"), F.array_join("m", "\n- ")).alias("text"))
    hubs = d.crossJoin(mean).where("degree >= least").select("id", "label")
    links = g.und().join(hubs, "id").join(g.nodes.select(F.col("id").alias("other"), F.col("label").alias("to")), "other")
    p = links.groupBy("id", "label").agg(F.sort_array(F.collect_list(F.concat_ws(" ", "relation", "to"))).alias("l"))
    return c.unionAll(p.select(F.concat(F.lit("node_"), F.regexp_replace("id", "[^A-Za-z0-9_-]", "_")), F.concat(F.lit("# "), "label", F.lit("\n\n- "), F.array_join("l", "\n- "))))


def notes(g: Graph) -> DataFrame:
    """(name, text): one vault note per node with links both ways; names unique."""
    names = variable_names(g.nodes)
    other = names.select(F.col("id").alias("other"), F.col("name").alias("to"))
    links = g.und().join(other, "other").groupBy("id").agg(F.sort_array(F.collect_set(F.concat(F.lit("[["), "to", F.lit("]]")))).alias("l"))
    n = g.nodes.join(names, "id").join(links, "id", "left")
    return n.select("name", F.concat(F.lit("# "), "label", F.lit("\n\n"), F.coalesce(F.array_join("l", "\n"), F.lit(""))).alias("text"))


def write_text(rows: DataFrame, path: str, first: str | None = None, last: str | None = None) -> None:
    """Lines in part order, as Spark text files, with fixed lines around them."""
    spark = rows.sparkSession
    every = rows.select(F.col("part").alias("part"), "line")
    for part, text in ((-1, first), (1 << 20, last)):
        if text is not None:
            every = every.unionAll(spark.createDataFrame([(part, text)], "part int, line string"))
    every.repartitionByRange("part", "line").sortWithinPartitions("part", "line").select("line").write.text(path)


def redis_script(g: Graph, name: str = "skein") -> DataFrame:
    """(part, line): MERGE statements as arguments of a graph command; escaped for Cypher, then for the shell of the store."""
    command = lambda c: F.concat(F.lit(f'GRAPH.QUERY {name} "'), redis_escape(c), F.lit('"'))
    q = lambda c: F.concat(F.lit("'"), cypher_escape(F.regexp_replace(c, r"[\r\n]+", " ")), F.lit("'"))
    kind = F.coalesce(F.nullif(F.initcap(F.regexp_replace("node_type", "[^A-Za-z0-9]", "")), F.lit("")), F.lit("Entity"))
    n = g.nodes.select(F.lit(0).alias("part"), command(F.concat(F.lit("MERGE (n:"), kind, F.lit(" {id: "), q(F.col("id")), F.lit("}) SET n.label = "), q(F.col("label")))).alias("line"))
    relation = F.upper(F.regexp_replace("relation", "[^A-Za-z0-9_]", "_"))
    e = g.edges.select(F.lit(1), command(F.concat(F.lit("MATCH (a {id: "), q(F.col("source")), F.lit("}), (b {id: "), q(F.col("target")), F.lit("}) MERGE (a)-[:"), relation, F.lit("]->(b)"))))
    return n.unionAll(e)


def community_pages(g: Graph) -> DataFrame:
    """(page, part, a, b, n): a page per community with its nodes (part 0) and inner links (1), and the page
    ``overview`` with communities (0) and the edges between them (1)."""
    n = g.nodes.where("community is not null").select("id", "community")
    page = lambda c: F.concat(F.lit("community_"), c.cast("string"))
    none = F.lit(None).cast("string")
    d = n.join(g.degree(), "id").select(page(F.col("community")).alias("page"), F.lit(0).alias("part"), F.col("id").alias("a"), none.alias("b"), F.col("degree").alias("n"))
    e = g.edges.join(n.select(F.col("id").alias("source"), F.col("community").alias("x")), "source").join(n.select(F.col("id").alias("target"), F.col("community").alias("y")), "target")
    count = F.count(F.lit(1)).alias("n")
    inner = e.where("x = y").groupBy("x", "source", "target").agg(count).select(page(F.col("x")), F.lit(1), "source", "target", "n")
    sizes = n.groupBy("community").agg(count).select(F.lit("overview"), F.lit(0), page(F.col("community")), none, "n")
    between = e.where("x <> y").groupBy(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).agg(count)
    return d.unionAll(inner).unionAll(sizes).unionAll(between.select(F.lit("overview"), F.lit(1), page(F.col("low")), page(F.col("high")), "n"))


def memory_documents(results: DataFrame) -> DataFrame:
    """(name, text) of saved results (type, question, answer, nodes, at): front matter, then the answer; the name holds type, time and a hash."""
    stamp = F.date_format("at", "yyyyMMdd'T'HHmmss")
    name = F.concat_ws("_", F.col("type"), stamp, fnv_digest(F.col("question")))
    cited = F.array_join(F.transform("nodes", lambda x: F.concat(F.lit("  - "), yaml_quote(x))), "\n")
    text = F.concat(
        F.lit("---\ntype: "), yaml_quote(F.col("type")), F.lit("\nquestion: "), yaml_quote(F.col("question")), F.lit("\ndate: "), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\nnodes:\n"), cited, F.lit("\n---\n\n"), F.col("answer"), F.lit("\n"),
    )
    return results.select(F.concat(name, F.lit(".md")).alias("name"), text.alias("text"))
