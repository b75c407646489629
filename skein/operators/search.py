"""Keyword search over nodes and the subgraphs it seeds."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import search_tokens
from skein.graph import Graph
from skein.operators.build import drop_dangling
from skein.operators.traverse import bfs

LABEL, ID, FILE = 2.0, 1.0, 0.5


def postings(g: Graph) -> DataFrame:
    """(token, id, weight): (base + 0.1 ln(1 + degree)) * kind, one row per token occurrence.

    Base: 2 / sqrt(tokens of the label), 1 for the id, 0.5 for the file.
    """
    kind = F.when(F.col("node_type").isin("module", "package", "namespace"), 0.35).when(F.col("node_type") == "file", 0.7).otherwise(1.0)
    n = g.nodes.join(g.degree(), "id").select("id", "label", "source_file", kind.alias("kind"), (0.1 * F.log1p("degree")).alias("boost"))

    def part(col: str, base) -> DataFrame:
        t = n.select("id", "kind", "boost", search_tokens(F.col(col)).alias("t"))
        return t.select("id", "kind", "boost", base(F.size("t")).alias("base"), F.explode("t").alias("token"))

    every = part("label", lambda k: LABEL / F.sqrt(k)).unionAll(part("id", lambda k: F.lit(ID))).unionAll(part("source_file", lambda k: F.lit(FILE)))
    return every.select("token", "id", ((F.col("base") + F.col("boost")) * F.col("kind")).alias("weight"))


def query_tokens(query: str) -> list[str]:
    """Blank-separated words of more than two bytes, lower case."""
    return [w.lower() for w in query.split() if len(w.encode()) > 2]


def search(g: Graph, terms: list[str], top_n: int = 10, index: DataFrame | None = None) -> DataFrame:
    """(id, score): whole-token weights and half weights of tokens that a term begins."""
    index = postings(g) if index is None else index
    hit = F.lit(0.0)
    for t in terms:  # a query has a handful of terms; the postings are scanned once
        hit = hit + F.when(F.col("token") == t, 1.0).when(F.col("token").startswith(t), 0.5).otherwise(0.0)
    found = index.withColumn("hit", hit).where("hit > 0").groupBy("id").agg(F.sum(F.col("weight") * F.col("hit")).alias("score"))
    return found.orderBy(F.desc(F.round("score", 9)), "id").limit(top_n)


def query_graph(g: Graph, question: str, seeds: int = 5, depth: int = 2, budget: int = 2000) -> DataFrame:
    """The neighbourhood of the best hits in discovery order, cut at ``budget * 4`` characters of labels.

    The row that crosses the budget is the last one kept.
    """
    start = [r.id for r in search(g, query_tokens(question), seeds).collect()]  # at most ``seeds`` rows
    found = bfs(g, start, depth).join(g.nodes.select("id", "label", "node_type", "source_file"), "id")
    order = Window.orderBy("depth", "id")
    before = F.coalesce(F.sum(F.length("label")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("_before", before).where(F.col("_before") < 4 * budget).drop("_before")


def neighbors(g: Graph, node: str, depth: int = 1, limit: int = 50, offset: int = 0) -> DataFrame:
    return bfs(g, [node], depth).where(F.col("id") != node).orderBy("depth", "id").offset(offset).limit(limit)


def community_members(g: Graph, community: int, limit: int = 50, offset: int = 0) -> DataFrame:
    m = g.nodes.where(F.col("community") == community).join(g.degree(), "id").select("id", "label", "degree")
    return m.orderBy(F.desc("degree"), "id").offset(offset).limit(limit)


def resolve_label(g: Graph, query: str, top_n: int = 5) -> DataFrame:
    """Nodes for a name: exact id 3, exact label 2, substring 1; symbols before files, then by degree."""
    q = query.lower()
    label = F.lower("label")
    tier = F.when(F.col("id") == query, 3).when(label == q, 2).when(label.contains(q), 1)
    n = g.nodes.withColumn("tier", tier).where("tier is not null").join(g.degree(), "id")
    symbol = (F.col("node_type") != "file").cast("int")
    return n.select("id", "label", "tier", symbol.alias("is_symbol"), "degree").orderBy(F.desc("tier"), F.desc("is_symbol"), F.desc("degree"), "id").limit(top_n)


def suggest(g: Graph, query: str, top_n: int = 5) -> DataFrame:
    """Nodes whose label holds the query or a part of it of three letters or more, best connected first."""
    q = query.lower()
    hit = F.lower("label").contains(q)
    for part in re.split(r"[^0-9a-z]+", q):
        if len(part) >= 3:
            hit = hit | F.lower("label").contains(part)
    return g.nodes.where(hit).join(g.degree(), "id").orderBy(F.desc("degree"), "id").limit(top_n).select("id", "label", "degree")


def edges_in_context(g: Graph, contexts: list[str]) -> DataFrame:
    """Edges whose ``extra.context`` is one of these and whose ends exist; a (source, target, relation) once."""
    e = g.edges.where(F.get_json_object("extra", "$.context").isin(*contexts))
    return drop_dangling(g.nodes, e).dropDuplicates(["source", "target", "relation"])


def is_ambiguous(ranked: DataFrame) -> DataFrame:
    """One row: whether the runner-up is of one tier and kind and within 10 % of the degree."""
    w = Window.orderBy(F.desc("tier"), F.desc("is_symbol"), F.desc("degree"), "id")
    two = ranked.select("*", F.row_number().over(w).alias("rn"), F.lead("tier").over(w).alias("t2"), F.lead("is_symbol").over(w).alias("s2"), F.lead("degree").over(w).alias("d2"))
    close = (F.col("tier") == F.col("t2")) & (F.col("is_symbol") == F.col("s2")) & (F.col("degree") - F.col("d2") < 0.1 * F.greatest("degree", F.lit(1)))
    return two.where("rn = 1").select("id", F.coalesce(close, F.lit(False)).alias("ambiguous"))


def explain(g: Graph, node: str, shown: int = 15) -> DataFrame:
    """Neighbours of a node by direction and relation, ``shown`` labels each."""
    out = g.edges.where(F.col("source") == node).select(F.lit("out").alias("direction"), "relation", F.col("target").alias("id"))
    into = g.edges.where(F.col("target") == node).select(F.lit("in").alias("direction"), "relation", F.col("source").alias("id"))
    rows = out.unionAll(into).join(g.nodes.select("id", "label"), "id")
    rn = F.row_number().over(Window.partitionBy("direction", "relation").orderBy("label", "id"))
    per = rows.withColumn("rn", rn).groupBy("direction", "relation")
    return per.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("rn") <= shown, F.col("label")))), ", ").alias("labels"))


def explore(g: Graph, question: str, depth: int = 2, budget: int = 4000, max_files: int = 15) -> DataFrame:
    """Files of the neighbourhood by number of symbols, within a budget of length + 100 per symbol."""
    start = [r.id for r in search(g, query_tokens(question), 5).collect()]
    found = bfs(g, start, depth).join(g.nodes.select("id", "source_file"), "id").where("source_file <> ''")
    files = found.groupBy("source_file").agg(F.count(F.lit(1)).alias("symbols")).orderBy(F.desc("symbols"), "source_file").limit(max_files)
    order = Window.orderBy(F.desc("symbols"), "source_file").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.length("source_file") + 100 * F.col("symbols")).over(order), F.lit(0))
    return files.withColumn("_spent", spent).where(F.col("_spent") < 4 * budget).drop("_spent")
