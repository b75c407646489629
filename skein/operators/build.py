"""Assembling, merging, comparing and pruning graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.graph import Graph

EDGE_KEY = ["source", "target", "relation"]


def first_wins(df: DataFrame, keys: list[str], order: list = ["_ord"]) -> DataFrame:  # noqa: B006
    """The first row by ``order`` of each key; nulls in keys are a key of their own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def drop_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def build(slices: list[Graph]) -> Graph:
    """Union of extraction slices; the first node of an id stays, dangling edges go, parallel edges stay."""
    nodes = reduce(DataFrame.unionByName, [s.nodes.withColumn("_slice", F.lit(i)) for i, s in enumerate(slices)])
    nodes = first_wins(nodes, ["id"], ["_slice", "_ord", "label"]).drop("_slice")
    edges = reduce(DataFrame.unionByName, [s.edges for s in slices])
    return Graph(nodes, drop_dangling(nodes, edges))


def graph_diff(old: Graph, new: Graph) -> DataFrame:
    """(kind, change, key...): node ids and (source, target, relation) triples added or removed."""
    none = F.lit(None).cast("string")

    def changes(a: DataFrame, b: DataFrame, change: str, keys: list[str], kind: str) -> DataFrame:
        d = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")
        cols = [F.col(k) for k in keys] if kind == "edge" else [F.col("id"), none, none]
        return d.select(F.lit(kind).alias("kind"), F.lit(change).alias("change"), *[c.alias(n) for c, n in zip(cols, ["source", "target", "relation"])])

    parts = [
        changes(new.nodes, old.nodes, "added", ["id"], "node"), changes(old.nodes, new.nodes, "removed", ["id"], "node"),
        changes(new.edges, old.edges, "added", EDGE_KEY, "edge"), changes(old.edges, new.edges, "removed", EDGE_KEY, "edge"),
    ]
    return reduce(DataFrame.unionAll, parts)


def diff_summary(old: Graph, new: Graph) -> DataFrame:
    d = graph_diff(old, new)
    n = lambda k, c: F.coalesce(F.sum(((F.col("kind") == k) & (F.col("change") == c)).cast("long")), F.lit(0)).alias(f"{k}s_{c}")
    one = d.agg(n("node", "added"), n("node", "removed"), n("edge", "added"), n("edge", "removed"))
    for name, g in (("old", old), ("new", new)):
        one = one.crossJoin(g.nodes.agg(F.count(F.lit(1)).alias(f"{name}_nodes"))).crossJoin(g.edges.agg(F.count(F.lit(1)).alias(f"{name}_edges")))
    return one


def merge_graphs(inputs: list[tuple[str, Graph]], namespaced: bool = False) -> tuple[Graph, DataFrame]:
    """N-way merge; earlier inputs win nodes, the higher confidence wins edges.

    Communities are renumbered so that inputs don't share any.  Returns the graph
    and one row of counters.
    """
    nodes, edges = [], []
    for i, (tag, g) in enumerate(inputs):
        n, e = g.nodes.withColumn("_in", F.lit(i)), g.edges.withColumn("_in", F.lit(i))
        if namespaced:
            local = F.col("id")
            n = n.withColumn("extra", F.to_json(F.struct(F.lit(tag).alias("repo"), local.alias("local_id")))).withColumn("id", F.concat(F.lit(tag + "::"), local))
            e = e.withColumn("source", F.concat(F.lit(tag + "::"), "source")).withColumn("target", F.concat(F.lit(tag + "::"), "target"))
        nodes.append(n)
        edges.append(e)
    n, e = reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)
    attributes = F.xxhash64(*[F.col(c) for c in n.columns if c not in ("id", "community", "_in", "_ord")])
    per = n.withColumn("_h", attributes).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_h").alias("kinds"))
    # Distinct (input, community) pairs get dense numbers in input order; a window over communities, not nodes.
    pairs = n.where("community is not null").select("_in", "community").distinct()
    number = (F.row_number().over(Window.orderBy("_in", "community")) - 1).cast("long")
    pairs = pairs.withColumn("_new", number)
    won = first_wins(n, ["id"], ["_in", "_ord", "label"]).join(pairs, ["_in", "community"], "left")
    won = won.withColumn("community", F.col("_new")).drop("_new", "_in").select(*inputs[0][1].nodes.columns)
    kept = first_wins(e, EDGE_KEY, [F.desc("confidence_score"), "_in", "_ord", "confidence"]).drop("_in")
    whole = drop_dangling(won, kept).select(*inputs[0][1].edges.columns)
    stats = (
        per.agg(F.sum("n").alias("nodes_in"), F.count(F.lit(1)).alias("nodes_out"), F.sum((F.col("kinds") > 1).cast("long")).alias("node_conflicts"))
        .crossJoin(e.agg(F.count(F.lit(1)).alias("edges_in")))
        .crossJoin(kept.agg(F.count(F.lit(1)).alias("edges_distinct")))
        .crossJoin(whole.agg(F.count(F.lit(1)).alias("edges_out")))
    )
    return Graph(won, whole), stats


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], ignore: tuple[str, ...] = ("_ord",)) -> DataFrame:
    """Merge two edits of one table; (columns of ``ours``, _conflict).

    Equal sides give ours; a side equal to base loses to the other; both changed
    gives ours and a conflict; a row on one side only stays if base lacks it,
    otherwise its deletion on the other side holds.
    """
    cols = ours.columns
    rest = [c for c in cols if c not in keys and c not in ignore]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(*cols).alias(name), F.to_json(F.struct(*rest)).alias(f"{name}_j"))

    j = side(base, "b").join(side(ours, "o"), keys, "full").join(side(theirs, "t"), keys, "full")
    o, t, b = F.col("o_j"), F.col("t_j"), F.col("b_j")
    both = o.isNotNull() & t.isNotNull()
    pick = (
        F.when(both & (o == t), F.col("o"))
        .when(both & b.eqNullSafe(o), F.col("t"))
        .when(both, F.col("o"))
        .when(o.isNotNull() & b.isNull(), F.col("o"))
        .when(t.isNotNull() & b.isNull(), F.col("t"))
    )
    clash = both & (o != t) & ~b.eqNullSafe(o) & ~b.eqNullSafe(t)
    return j.select(pick.alias("p"), F.coalesce(clash, F.lit(False)).alias("_conflict")).where("p is not null").select("p.*", "_conflict")


def three_way_merge(base: Graph, ours: Graph, theirs: Graph) -> Graph:
    nodes = three_way(base.nodes, ours.nodes, theirs.nodes, ["id"]).drop("_conflict")
    edges = three_way(*[first_wins(g.edges, EDGE_KEY) for g in (base, ours, theirs)], EDGE_KEY).drop("_conflict")
    return Graph(nodes, drop_dangling(nodes, edges))


def belongs_to(tag: str, repo: Column, node_id: Column) -> Column:
    return F.coalesce(repo == tag, node_id.startswith(f"{tag}::"))


def prune_repo(g: Graph, tag: str) -> Graph:
    """Without the nodes of a repository, their edges, and hyperedges that lose a member."""
    gone = g.nodes.where(belongs_to(tag, F.get_json_object("extra", "$.repo"), F.col("id"))).select("id")
    nodes = g.nodes.join(gone, "id", "left_anti")
    hyper = g.hyperedges
    if hyper is not None:
        h = hyper.withColumn("_h", F.xxhash64(F.to_json(F.struct(*hyper.columns))))
        lost = h.select("_h", F.explode("nodes").alias("id")).join(gone, "id", "left_semi").select("_h").distinct()
        hyper = h.join(lost, "_h", "left_anti").drop("_h")
    return Graph(nodes, drop_dangling(nodes, g.edges), hyper)


def graft(store: Graph, incoming: Graph, tag: str) -> Graph:
    """Replace a repository's part of a global store; external symbols join on label.

    The incoming communities start after the store's; incoming nodes without a
    source file that bear the label of a stored one become that one; self-loops
    and repeated triples go.
    """
    kept = prune_repo(store, tag)
    (g, _) = merge_graphs([(tag, incoming)], namespaced=True)
    top = kept.nodes.agg(F.coalesce(F.max("community") + 1, F.lit(0)).alias("_top"))  # one row
    g_nodes = g.nodes.crossJoin(top).withColumn("community", F.col("community") + F.col("_top")).drop("_top")
    known = kept.nodes.where("source_file = ''").groupBy("label").agg(F.min("id").alias("_to"))
    same = g_nodes.where("source_file = ''").join(known, "label").select("id", "_to")
    nodes = kept.nodes.unionByName(g_nodes.join(same, "id", "left_anti"))
    moved = g.edges
    for end in ("source", "target"):
        moved = moved.join(same.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    edges = first_wins(kept.edges.withColumn("_in", F.lit(0)).unionByName(moved.withColumn("_in", F.lit(1))), EDGE_KEY, ["_in", "_ord"]).drop("_in")
    return Graph(nodes, drop_dangling(nodes, edges.where("source <> target")), kept.hyperedges)


def merge_chunks(chunks: list[Graph]) -> Graph:
    """Chunk merge: first node by id wins (rows without an id share one slot), edges are all kept."""
    nodes = reduce(DataFrame.unionByName, [c.nodes.withColumn("_in", F.lit(i)) for i, c in enumerate(chunks)])
    edges = reduce(DataFrame.unionByName, [c.edges for c in chunks])
    return Graph(first_wins(nodes, ["id"], ["_in", "_ord"]).drop("_in"), edges)


def shrinks(old: Graph, new: Graph) -> bool:
    """Whether replacing ``old`` by ``new`` would lose nodes (two counts)."""
    return new.nodes.count() < old.nodes.count()
