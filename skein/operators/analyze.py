"""Whole-graph analysis: counts, hubs, bridges, cohesion, surprises, questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.graph import Graph

#: Labels that say little without their directory.
VAGUE_LABELS = ("lib", "mod", "main", "index", "init")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_file_hub(label: Column, source_file: Column) -> Column:
    """A node that only stands for its file: its label is the file's name."""
    return (source_file != "") & (label == basename(source_file))


def is_method_stub(label: Column, degree: Column) -> Column:
    """``.x()`` anywhere, ``x()`` where hardly anything touches it."""
    return label.rlike(r"^\..*\(\)$") | (label.rlike(r"\(\)$") & (degree <= 1))


def graph_stats(g: Graph) -> DataFrame:
    """One row: node, edge and community counts, largest and mean degree (text, two places)."""
    n = g.nodes.agg(F.count(F.lit(1)).alias("node_count"), F.count_distinct("community").alias("community_count"))
    e = g.edges.agg(F.count(F.lit(1)).alias("edge_count"))
    top = g.degree().agg(F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"))
    # Three one-row tables.
    one = n.crossJoin(e).crossJoin(top)
    mean = F.when(F.col("node_count") > 0, 2.0 * F.col("edge_count") / F.col("node_count")).otherwise(F.lit(0.0))
    return one.select("node_count", "edge_count", "community_count", "max_degree", F.format_string("%.2f", mean).alias("avg_degree"))


def type_counts(g: Graph) -> DataFrame:
    return g.nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


def relation_counts(g: Graph, top_n: int = 15) -> DataFrame:
    return g.edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "relation").limit(top_n)


def confidence_breakdown(g: Graph) -> DataFrame:
    c = g.edges.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))
    share = 100.0 * F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1))  # three rows
    return c.select("confidence", "n", F.format_string("%.1f", share).alias("percent"))


def god_nodes(g: Graph, top_n: int = 10, exclude_file_type: bool = False) -> DataFrame:
    """The most connected nodes that are neither file hubs nor method stubs, ranked from 1."""
    nodes = g.nodes.join(g.degree(), "id")
    nodes = nodes.where(~is_file_hub(F.col("label"), F.col("source_file")) & ~is_method_stub(F.col("label"), F.col("degree")))
    if exclude_file_type:
        nodes = nodes.where("node_type <> 'file'")
    parent = F.element_at(F.split("source_file", "/"), -2)
    label = F.when(
        F.col("label").isin(*VAGUE_LABELS) & (F.size(F.split("source_file", "/")) > 1), F.concat(parent, F.lit("::"), F.col("label"))
    ).otherwise(F.col("label"))
    top = nodes.orderBy(F.desc("degree"), "id").limit(top_n)
    rank = F.row_number().over(Window.orderBy(F.desc("degree"), "id"))  # over top_n rows
    return top.select(rank.alias("rank"), "id", label.alias("label"), "degree", "community")


def with_communities(g: Graph) -> DataFrame:
    """Edges with the community of either end (null where it has none)."""
    c = g.nodes.select("id", "community")
    a = c.select(F.col("id").alias("source"), F.col("community").alias("source_community"))
    b = c.select(F.col("id").alias("target"), F.col("community").alias("target_community"))
    return g.edges.join(a, "source", "left").join(b, "target", "left")


def surprising_connections(g: Graph, top_n: int = 5) -> DataFrame:
    """Edges that cross communities or files or are uncertain, highest score first.

    Ends without a community share one; parallel edges each have a row.
    """
    files = g.nodes.select("id", F.col("source_file").alias("f"), F.coalesce("community", F.lit(-1)).alias("k"))
    e = g.edges.select("source", "target", "relation", "confidence")
    e = e.join(files.select(F.col("id").alias("source"), F.col("f").alias("fa"), F.col("k").alias("ka")), "source")
    e = e.join(files.select(F.col("id").alias("target"), F.col("f").alias("fb"), F.col("k").alias("kb")), "target")
    score = (
        F.when(F.col("ka") != F.col("kb"), 2.0).otherwise(0.0)
        + F.when(F.col("fa") != F.col("fb"), 1.0).otherwise(0.0)
        + F.when(F.col("confidence") == "AMBIGUOUS", 3.0).when(F.col("confidence") == "INFERRED", 1.5).otherwise(0.0)
    )
    e = e.select("source", "target", "relation", "confidence", score.alias("score")).where("score > 0")
    return e.orderBy(F.desc("score"), "source", "target", "relation").limit(top_n)


def community_bridges(g: Graph, top_n: int = 10) -> DataFrame:
    """Nodes by the share of their neighbour rows in other communities.

    File hubs, nodes and neighbours without a community are left out; a node
    with no foreign neighbour is no bridge.
    """
    member = g.nodes.where("community is not null and not (source_file <> '' and label = element_at(split(source_file, '/'), -1))")
    own = member.select("id", "label", "community")
    near = g.nodes.where("community is not null").select(F.col("id").alias("other"), F.col("community").alias("near"))
    seen = g.und().select("id", "other").join(own, "id").join(near, "other")
    per = seen.groupBy("id", "label", "community").agg(
        F.count(F.lit(1)).alias("total_edges"),
        F.sum((F.col("near") != F.col("community")).cast("long")).alias("cross_edges"),
        F.sort_array(F.array_distinct(F.concat(F.collect_set("near"), F.array(F.first("community"))))).alias("touched"),
    )
    per = per.where("cross_edges > 0").withColumn("bridge_ratio", F.col("cross_edges") / F.col("total_edges"))
    return per.orderBy(F.desc("bridge_ratio"), F.desc("cross_edges"), "id").limit(top_n)


def cohesion(g: Graph, places: int | None = 2) -> DataFrame:
    """(community, size, internal_edges, cohesion); parallel edges count, one member gives 1."""
    size = g.nodes.where("community is not null").groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    inside = with_communities(g).where("source_community = target_community").groupBy(F.col("source_community").alias("community")).agg(F.count(F.lit(1)).alias("internal_edges"))
    c = size.join(inside, "community", "left").withColumn("internal_edges", F.coalesce("internal_edges", F.lit(0)))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    value = F.when(F.col("size") <= 1, F.lit(1.0)).otherwise(F.col("internal_edges") / F.when(F.col("size") > 1, pairs))
    return c.select("community", "size", "internal_edges", (value if places is None else F.round(value, places)).alias("cohesion"))


def cross_community(g: Graph, top_n: int = 20) -> DataFrame:
    """Edge counts between communities, unordered pairs."""
    e = with_communities(g).where("source_community <> target_community")
    low, high = F.least("source_community", "target_community"), F.greatest("source_community", "target_community")
    c = e.groupBy(low.alias("low"), high.alias("high")).agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), "low", "high").limit(top_n)


def representatives(g: Graph) -> DataFrame:
    """The member of each community with most edges; the smallest id on a tie."""
    d = g.nodes.where("community is not null").join(g.degree(), "id")
    best = d.groupBy("community").agg(F.min(F.struct((-F.col("degree")).alias("d"), "id", "label")).alias("b"), F.count(F.lit(1)).alias("size"))
    return best.select("community", "size", F.col("b.id").alias("id"), F.col("b.label").alias("label"), (-F.col("b.d")).alias("degree"))


def parent_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def directory_nodes(g: Graph, top_n: int = 30) -> DataFrame:
    d = g.nodes.where("source_file <> ''").groupBy(parent_dir(F.col("source_file")).alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    return d.orderBy(F.desc("n"), "dir").limit(top_n)


def directory_edges(g: Graph, top_n: int = 20) -> DataFrame:
    """Edge counts between the directories of the ends, unordered pairs of different ones."""
    d = g.nodes.where("source_file <> ''").select("id", parent_dir(F.col("source_file")).alias("d"))
    e = g.edges.join(d.select(F.col("id").alias("source"), F.col("d").alias("a")), "source").join(d.select(F.col("id").alias("target"), F.col("d").alias("b")), "target")
    c = e.where("a <> b").groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), "low", "high").limit(top_n)


def isolated_share(g: Graph) -> DataFrame:
    """One row: isolated nodes and their whole percentage."""
    d = g.degree().agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum((F.col("degree") == 0).cast("long")), F.lit(0)).alias("isolated"))
    return d.select("nodes", "isolated", F.when(F.col("nodes") > 0, F.expr("isolated * 100 div greatest(nodes, 1)")).otherwise(F.lit(0)).alias("percent"))


def temporal_risk(g: Graph, commits: DataFrame, today: Column, top_n: int = 10) -> DataFrame:
    """Churn times connectedness from ``commits`` (file, ts): (commits / age in days) * degree / largest degree."""
    per = commits.groupBy("file").agg(F.count(F.lit(1)).alias("commits"), F.min("ts").alias("first"))
    d = g.nodes.join(g.degree(), "id").join(per, F.col("source_file") == F.col("file"))
    top = g.degree().agg(F.max("degree").alias("top"))  # one row
    age = F.greatest(F.datediff(today, F.to_date("first")), F.lit(1))
    risk = F.col("commits") / age * F.col("degree") / F.greatest("top", F.lit(1))
    return d.crossJoin(top).select("id", "label", "commits", "degree", risk.alias("risk")).where("risk > 0").orderBy(F.desc("risk"), "id").limit(top_n)


def suggest_questions(g: Graph, top_n: int = 7) -> DataFrame:
    """Questions by category, in category order, then cut to ``top_n``.

    0 uncertain edges, 1 bridges, 2 hubs with inferred edges, 3 isolated nodes,
    4 loose communities.
    """
    label = g.nodes.select("id", "label")
    e = g.edges.where("confidence = 'AMBIGUOUS'").orderBy("source", "target", "relation").limit(top_n)
    e = e.join(label.select(F.col("id").alias("source"), F.col("label").alias("a")), "source").join(label.select(F.col("id").alias("target"), F.col("label").alias("b")), "target")
    uncertain = e.select(
        F.lit(0).alias("category"), F.concat_ws("|", "source", "target", "relation").alias("key"),
        F.format_string("Does `%s` really %s `%s`?", "a", "relation", "b").alias("question"),
    )
    b = community_bridges(g, top_n)
    bridges = b.select(F.lit(1), "id", F.format_string("Why does `%s` connect %d communities?", "label", F.size("touched")))
    guess = g.und().where("confidence = 'INFERRED'").select("id").distinct()
    hubs = god_nodes(g, 10).join(guess, "id", "left_semi").select(F.lit(2), "id", F.format_string("Are the inferred relations of `%s` right?", "label"))
    lone = g.nodes.join(g.degree().where("degree = 0"), "id").orderBy("id").limit(top_n).select(F.lit(3), "id", F.format_string("What is `%s` for?", "label"))
    loose = cohesion(g).where("size >= 5 and cohesion < 0.15").select(
        F.lit(4), F.format_string("%012d", "community"), F.format_string("Should community %d be split?", "community")
    )
    every = uncertain.unionAll(bridges).unionAll(hubs).unionAll(lone).unionAll(loose)
    return every.orderBy("category", "key").limit(top_n)
