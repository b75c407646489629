"""Sections of a graph by community: edges within and between, keywords, summaries, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import search_tokens, token_estimate
from skein.graph import Graph

#: Words that say nothing about a section.
STOP_WORDS = ("the", "and", "for", "new", "get", "set", "from", "with", "self", "test", "tests", "src", "lib", "mod", "main", "index", "init", "impl", "type", "def")


def drawn(confidence: Column, score: Column) -> Column:
    """Edges fit for a diagram: certain, or inferred with a score of 0.85 or more."""
    return (confidence == "EXTRACTED") | ((confidence == "INFERRED") & (score >= 0.85))


def section_edges(g: Graph) -> DataFrame:
    """(src, dst, n, relation): drawn edges between sections with their most frequent relation, ties by name."""
    c = g.nodes.where("community is not null").select("id", "community")
    e = g.edges.where(drawn(F.col("confidence"), F.col("confidence_score")))
    e = e.join(c.select(F.col("id").alias("source"), F.col("community").alias("src")), "source").join(c.select(F.col("id").alias("target"), F.col("community").alias("dst")), "target")
    per = e.where("src <> dst").groupBy("src", "dst", "relation").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("src", "dst").agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("k"), "relation")).alias("b")).select("src", "dst", "n", F.col("b.relation").alias("relation"))


def section_keywords(g: Graph, top_n: int = 3) -> DataFrame:
    """(community, keyword, n, rank): frequent words of three letters or more in labels and files."""
    words = F.filter(F.concat(search_tokens(F.col("label")), search_tokens(F.col("source_file"))), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))
    n = g.nodes.where("community is not null").select("community", F.explode(words).alias("keyword")).groupBy("community", "keyword").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "keyword"))
    return n.withColumn("rank", rank).where(F.col("rank") <= top_n)


def summaries(g: Graph, top_k: int = 12) -> DataFrame:
    """(community, size, labels): distinct labels, case aside, by degree; largest community first."""
    n = g.nodes.where("community is not null").join(g.degree(), "id").withColumn("label", F.btrim("label"))
    size = n.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    one = n.groupBy("community", F.lower("label").alias("key")).agg(F.min(F.struct((-F.col("degree")).alias("d"), "id", "label")).alias("b"))
    rn = F.row_number().over(Window.partitionBy("community").orderBy("b.d", "b.id"))
    best = one.where("key <> ''").withColumn("rn", rn).where(F.col("rn") <= top_k)
    labels = best.groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", F.col("b.label").alias("l")))), lambda x: x["l"]).alias("labels"))
    return size.join(labels, "community", "left").orderBy(F.desc("size"), "community")


def token_reduction(g: Graph, question: str, corpus_words: int, top_n: int = 5) -> DataFrame:
    """One row: tokens of the subgraph of a question against those of the corpus."""
    terms = [w.lower() for w in question.split() if len(w) > 2]
    hits = F.lit(0)
    for t in terms:
        hits = hits + F.lower("label").contains(t).cast("int")
    start = g.nodes.withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), "id").limit(top_n).select("id")
    near = g.und().join(start, "id", "left_semi").select(F.col("other").alias("id")).unionAll(start).distinct()
    used = g.nodes.join(near, "id", "left_semi").agg(F.coalesce(F.sum(token_estimate(F.col("label"))), F.lit(0)).alias("tokens"))
    total = F.ceil(F.lit(corpus_words) * 1.3)
    tokens = F.when(F.col("tokens") == 0, F.ceil(total / 5)).otherwise(F.col("tokens"))
    return used.select(total.alias("corpus_tokens"), tokens.alias("query_tokens"), F.round(total / F.greatest(tokens, F.lit(1)), 2).alias("reduction"))
