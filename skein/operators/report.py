"""Reports: the Markdown report of a graph, its health, caches and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.graph import Graph
from skein.operators import analyze
from skein.operators.cluster import heuristic_labels


def report_lines(g: Graph, top_n: int = 10) -> list[str]:
    """The report: sizes, certainty, hubs, surprises, communities and questions; each table has at most ``top_n`` rows."""
    stats = analyze.graph_stats(g).first().asDict()
    out = ["# Graph report", "", *[f"- {k}: {v}" for k, v in stats.items()], "", "## Certainty", "", "| confidence | edges | percent |", "|-|-|-|"]
    out += [f"| {r.confidence} | {r.n} | {r.percent} |" for r in analyze.confidence_breakdown(g).orderBy("confidence").collect()]
    out += ["", "## Hubs", "", "| node | degree |", "|-|-|"] + [f"| {r.label} | {r.degree} |" for r in analyze.god_nodes(g, top_n).collect()]
    out += ["", "## Surprises", ""] + [f"- {r.source} {r.relation} {r.target}" for r in analyze.surprising_connections(g, top_n).collect()]
    names = heuristic_labels(g)
    c = analyze.cohesion(g).join(names, "community").orderBy(F.desc("size"), "community").limit(top_n)
    out += ["", "## Communities", "", "| community | nodes | cohesion |", "|-|-|-|"] + [f"| {r.label} | {r['size']} | {r.cohesion:.2f} |" for r in c.collect()]
    out += ["", "## Questions", ""] + [f"- {r.question}" for r in analyze.suggest_questions(g, top_n).collect()]
    return out


def smart_summary(g: Graph, level: str = "community", budget: int = 2000) -> DataFrame:
    """(place, line): communities (or directories) with their size and main member, then the edges between them,
    up to the line that crosses ``budget * 4`` characters."""
    if level == "community":
        items = analyze.representatives(g).select(
            F.lit(0).alias("part"), (-F.col("size")).alias("k"), F.format_string("community %d: %d nodes around %s", "community", "size", "label").alias("line")
        )
        links = analyze.cross_community(g).select(F.lit(1), -F.col("n"), F.format_string("%d - %d: %d edges", "low", "high", "n"))
    else:
        items = analyze.directory_nodes(g).select(F.lit(0).alias("part"), (-F.col("n")).alias("k"), F.format_string("%s: %d", "dir", "n").alias("line"))
        links = analyze.directory_edges(g).select(F.lit(1), -F.col("n"), F.format_string("%s - %s: %d edges", "low", "high", "n"))
    rows = items.unionAll(links)
    order = Window.orderBy("part", "k", "line")  # a row per community
    before = F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("place", F.row_number().over(order)).where(F.col("before") < 4 * budget)
    return rows.select("place", "line")


def cache_liveness(entries: DataFrame, live: DataFrame) -> DataFrame:
    """One row: (live, live_bytes, stale, stale_bytes) of cache ``entries`` (hash, bytes) against ``live`` hashes (hash)."""
    j = entries.join(live.select("hash").distinct().withColumn("is_live", F.lit(True)), "hash", "left").withColumn("is_live", F.coalesce("is_live", F.lit(False)))
    kept, gone = F.col("is_live"), ~F.col("is_live")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("bytes"))), F.lit(0))
    return j.agg(F.count_if(kept).alias("live"), total(kept).alias("live_bytes"), F.count_if(gone).alias("stale"), total(gone).alias("stale_bytes"))


def diagnosis(g: Graph, files: DataFrame, built_at: Column) -> DataFrame:
    """One row: nodes, isolated ones and their whole percentage, named communities, files newer than the graph."""
    iso = analyze.isolated_share(g)
    named = g.nodes.agg(F.count_distinct("community").alias("communities"))
    newer = files.agg(F.count_if(F.col("mtime") > built_at).alias("newer_files"))
    return iso.crossJoin(named).crossJoin(newer)  # one row each


STATUS_ORDER = ("failing", "changes", "approved", "open", "draft", "stale")


def status_rank(status: Column) -> Column:
    out = F.lit(len(STATUS_ORDER))
    for i, s in enumerate(STATUS_ORDER):
        out = F.when(status == s, i).otherwise(out)
    return out


def sorted_changes(changes: DataFrame) -> DataFrame:
    """Changes (number, status, age_days) in the order of work: by status, oldest first, then number."""
    return changes.orderBy(status_rank(F.col("status")), F.desc("age_days"), "number")


def status_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def token_totals(chunks: DataFrame) -> DataFrame:
    """One row: sums of ``input_tokens`` and ``output_tokens``, absent ones 0."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c)
    return chunks.agg(total("input_tokens"), total("output_tokens"))
