"""Walks over the graph: frontier loops of joins, one durable table per round.

All loops run to their fixpoint; none stops at a number of rounds unless the
operator itself has one (a depth, a path length, the rounds of a rank).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import is_test_file
from skein.graph import Graph
from skein.plans.components import connected_components as _components
from skein.plans.rounds import Rounds
from skein.plans.storage import drop, measured, table

#: Relations that carry dependency.
DEPENDS = ("imports", "imports_from", "uses", "calls", "includes")
AFFECTS = ("imports", "imports_from", "uses", "calls")
#: So many frontiers are read side by side before they are written as one table.
FRONTIERS = 8


def _rows() -> Column:
    return F.count(F.lit(1))


def _ids(spark, ids: list[str]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string").distinct()


class _Seen:
    """What a walk has reached, as a few tables."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, new: DataFrame) -> None:
        self.parts.append(new)
        if len(self.parts) > FRONTIERS:
            self.parts = [table(self.all(), "seen")]

    def all(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionAll(p)
        return out


def _reach(steps: DataFrame, start: DataFrame, depth: int | None) -> DataFrame:
    """(id, depth) over (id, other) steps, to the end if no depth is given; a round joins the frontier only."""
    frontier = table(start.select("id", F.lit(0).alias("depth")), "seen")
    seen, d = _Seen(frontier), 0
    while depth is None or d < depth:
        d += 1
        new = steps.join(frontier, "id", "left_semi").select(F.col("other").alias("id")).distinct().join(seen.all(), "id", "left_anti")
        frontier, got = measured(new.select("id", F.lit(d).alias("depth")), "frontier", n=_rows())
        if not got["n"]:
            break
        seen.add(frontier)
    return seen.all()


def bfs(g: Graph, start: list[str], depth: int) -> DataFrame:
    """(id, depth): nodes within ``depth`` steps of existing start nodes, either direction."""
    first = _ids(g.nodes.sparkSession, start).join(g.nodes.select("id"), "id", "left_semi")
    return _reach(g.und().select("id", "other"), first, depth)


def expansions(g: Graph, reached: DataFrame, depth: int) -> DataFrame:
    """(source, target): a row for each step that a walk to ``depth`` looked at, from each end it was reached at."""
    inner = reached.where(F.col("depth") < depth).select("id")
    return g.und().select("id", "other").join(inner, "id", "left_semi").select(F.col("id").alias("source"), F.col("other").alias("target"))


def dfs(g: Graph, start: list[str], depth: int) -> DataFrame:
    """(id, depth, place): a depth-first walk that marks nodes as it stacks them, neighbours in id order.

    A node first met deep down is not walked again from a shallower place, so the
    walk depends on its order: it runs in one task over the neighbourhood of
    ``depth`` steps, which is what bounds it.
    """
    spark = g.nodes.sparkSession
    near = table(bfs(g, start, depth), "near")
    steps = g.und().select("id", "other").distinct()
    inner = steps.join(near.select("id"), "id", "left_semi").join(near.select(F.col("id").alias("other")), "other", "left_semi")
    lists = inner.groupBy("id").agg(F.sort_array(F.collect_list("other")).alias("others"))

    def walk(batches):
        import pandas as pd

        after = {r.id: list(r.others) for b in batches for r in b.itertuples()}
        stack = [(i, 0) for i in reversed(first)]
        marked = {i for i, _ in stack}
        rows = []
        while stack:
            i, d = stack.pop()
            rows.append((i, d, len(rows)))
            if d < depth:
                for o in after.get(i, []):
                    if o not in marked:
                        marked.add(o)
                        stack.append((o, d + 1))
        yield pd.DataFrame(rows, columns=["id", "depth", "place"])

    known = {r.id for r in near.where("depth = 0").collect()}
    first = [i for i in dict.fromkeys(start) if i in known]
    alone = near.where("depth = 0").join(lists.select("id"), "id", "left_anti").select("id", F.array().cast("array<string>").alias("others"))
    out = lists.unionByName(alone).coalesce(1).mapInPandas(walk, "id string, depth int, place int")
    return out if first else spark.createDataFrame([], "id string, depth int, place int")


def affected(g: Graph, changed_files: list[str], depth: int = 5) -> DataFrame:
    """(id, depth): what depends, over ``AFFECTS``, on nodes of the changed files."""
    start = g.nodes.where(F.col("source_file").isin(changed_files)).select("id")
    back = g.edges.where(F.col("relation").isin(*AFFECTS)).select(F.col("target").alias("id"), F.col("source").alias("other"))
    return _reach(back, start, depth)


def affected_tests(g: Graph, changed_files: list[str], depth: int = 5) -> DataFrame:
    """(file): the test files, not changed themselves, that depend on the changed files."""
    reached = affected(g, changed_files, depth).select("id")
    files = g.nodes.join(reached, "id", "left_semi").select(F.col("source_file").alias("file")).distinct()
    return files.where(is_test_file(F.col("file")) & ~F.col("file").isin(changed_files)).orderBy("file")


def shortest_path(g: Graph, source: str, target: str) -> list[str] | None:
    """Of the shortest paths the one that is smallest when its ids are joined by ``|``, or None if there is no path."""
    if source == target:
        return [source]
    steps = g.und().select("id", "other").distinct()
    frontier = table(_ids(g.nodes.sparkSession, [source]).select("id", F.struct(F.col("id").alias("joined"), F.array("id").alias("ids")).alias("path")), "seen")
    seen = _Seen(frontier.select("id"))
    while True:
        longer = F.struct(F.concat_ws("|", "path.joined", "other").alias("joined"), F.concat("path.ids", F.array("other")).alias("ids"))
        hop = steps.join(frontier, "id").select(F.col("other").alias("id"), longer.alias("path"))
        new = hop.groupBy("id").agg(F.min("path").alias("path")).join(seen.all(), "id", "left_anti")
        frontier, got = measured(new.select("id", "path"), "frontier", n=_rows(), hit=F.min(F.when(F.col("id") == target, F.col("path"))))
        if not got["n"]:
            return None
        if got["hit"]:
            return list(got["hit"].ids)
        seen.add(frontier.select("id"))


def simple_paths(g: Graph, source: str, target: str, max_length: int = 4, limit: int = 50) -> DataFrame:
    """(length, path): paths without repeated nodes of at most ``max_length`` edges, shortest first."""
    spark = g.nodes.sparkSession
    steps = g.und().select("id", "other").distinct()
    # Only nodes close enough to the target can lie on such a path.
    near = _reach(steps, _ids(spark, [target]), max_length).withColumnRenamed("depth", "left")
    paths = _ids(spark, [source]).select("id", F.array("id").alias("path"))
    done, found = None, 0
    for d in range(1, max_length + 1):
        if found >= limit:  # all further paths are longer
            break
        grown = (
            paths.where(F.col("id") != target).join(steps, "id").where(~F.array_contains("path", F.col("other")))
            .select(F.col("other").alias("id"), F.concat("path", F.array("other")).alias("path"))
        )
        paths, got = measured(grown.join(near, "id").where(F.col("left") <= max_length - d).select("id", "path"), "paths", hits=F.count_if(F.col("id") == target))
        found += got["hits"]
        hit = paths.where(F.col("id") == target).select(F.lit(d).alias("length"), F.array_join("path", " > ").alias("path"))
        done = hit if done is None else done.unionAll(hit)
    return done.orderBy("length", "path").limit(limit)


def weighted_distances(g: Graph, source: str, min_confidence: float = 0.0) -> DataFrame:
    """(id, cost, prev): cheapest walks at cost 1 / weight over edges of enough confidence.

    Relaxation rounds send only what improved and end when nothing does; equal
    costs keep the smaller ``prev``.
    """
    cost = F.when(F.col("weight") > 0, 1.0 / F.when(F.col("weight") > 0, F.col("weight")))
    e = g.und().where(F.col("confidence_score") >= min_confidence).select("id", "other", cost.alias("c")).where("c is not null")
    e = table(e.groupBy("id", "other").agg(F.min("c").alias("c")), "costs")
    best = table(_ids(g.nodes.sparkSession, [source]).select("id", F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("prev"), F.lit(True).alias("new")), "best")
    while True:
        front = best.where("new").select("id", "cost")
        offer = e.join(front, "id").select(F.col("other").alias("id"), (F.col("cost") + F.col("c")).alias("cost"), F.col("id").alias("prev"))
        offer = offer.groupBy("id").agg(F.min(F.struct("cost", "prev")).alias("o"))
        j = best.join(offer, "id", "full")
        better = F.col("o").isNotNull() & (F.col("cost").isNull() | (F.col("o.cost") < F.col("cost") - 1e-12))
        nxt, got = measured(
            j.select("id", F.when(better, F.col("o.cost")).otherwise(F.col("cost")).alias("cost"), F.when(better, F.col("o.prev")).otherwise(F.col("prev")).alias("prev"), better.alias("new")),
            "best",
            n=F.count_if("new"),
        )
        drop(best)
        best = nxt
        if not got["n"]:
            return best.select("id", "cost", "prev")


def weighted_path(g: Graph, source: str, target: str, min_confidence: float = 0.0) -> tuple[list[str], float] | None:
    """The nodes of the cheapest walk and its cost; the way back is found by doubling steps."""
    d = weighted_distances(g, source, min_confidence)
    at = d.where(F.col("id") == target).first()
    if at is None:
        return None
    jump = d.where("prev is not null").select("id", F.col("prev").alias("to"))
    on = _ids(d.sparkSession, [target])
    n = 1
    while True:  # after k rounds: the target and its 2**k - 1 nearest ancestors
        further = on.join(jump, "id").select(F.col("to").alias("id"))
        on, got = measured(on.unionAll(further).distinct(), "on", n=_rows())
        if got["n"] == n:
            break
        n = got["n"]
        jump = table(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", "b.to"), "jump")
    path = [r.id for r in d.join(on, "id", "left_semi").orderBy("cost", "id").collect()]  # one row per step
    return path, at.cost


def pagerank(g: Graph, top_n: int = 10, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """Undirected rank; parallel edges count, dangling mass is spread evenly.

    The edges are dealt over parts once; a round sends a rank for each node and part
    it has a neighbour in, and its change and loose mass are measured while it is written.
    """
    x = F.xxhash64("id")
    nodes = g.nodes.select(x.alias("x"), x.alias("n"), x.alias("t"))
    rounds_ = Rounds(nodes, g.edges.select(F.xxhash64("source").alias("x"), F.xxhash64("target").alias("y")), weighted=False, loops=True)
    n = rounds_.nodes
    if n == 0:
        return g.nodes.select("id", F.lit(0.0).alias("rank"))

    def step(even: float | None):
        def run(part):
            degree, real = part.degree, part.real
            if even is None:
                new, moved = np.where(real, 1.0 / n, 0.0), 0.0
            else:
                got = np.zeros(len(degree))
                for lo, hi in part.blocks():
                    a, z = part.start[lo], part.start[hi]
                    full = lo + np.nonzero(np.diff(part.start[lo : hi + 1]))[0]
                    if len(full):
                        got[full] = np.add.reduceat(part.halo[part.other[a:z]] * part.weight[a:z], part.start[full] - a)
                new = np.where(real, even + damping * got, 0.0)
                moved = np.abs(new - part.own).sum()
            return new, new / np.maximum(degree, 1), new[degree == 0].sum(), moved

        return run

    names = ("degree", "real", "count", "other", "weight")
    loose, _ = rounds_.step(names, step(None))
    for _ in range(rounds):
        loose, moved = rounds_.step(names, step((1 - damping) / n + damping * loose / n))
        if moved < tolerance:
            break
    rank = rounds_.result("double").withColumnRenamed("n", "x").withColumn("r", F.round("value", 12))
    rank = table(rank, "rank")
    least = rank.select("r").orderBy(F.desc("r")).limit(top_n).agg(F.min("r")).first()[0]
    top = rank.where(F.col("r") >= F.lit(least)).select("x", "value")
    return g.nodes.select("id", x.alias("x")).join(top, "x").select("id", F.col("value").alias("rank")).orderBy(F.desc(F.round("rank", 12)), "id").limit(top_n)


def connected_components(g: Graph) -> DataFrame:
    """(id, component) of every node; component = smallest id."""
    c = _components(g.edges.select(F.col("source").alias("src"), F.col("target").alias("dst")))
    return g.nodes.select("id").join(c.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected sets of more than one node; component = smallest id.

    Each round colours forwards by the smallest ancestor, then gathers backwards from
    the nodes that kept their own colour; what is settled leaves the graph.
    """
    e, got = measured(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a <> b").distinct(), "scc", n=_rows())
    n, done = got["n"], None
    while n:
        while True:  # trim: nodes without an edge in or out are alone
            ins, outs = e.select(F.col("b").alias("a")).distinct(), e.select(F.col("a").alias("b")).distinct()
            t, got = measured(e.join(ins, "a", "left_semi").join(outs, "b", "left_semi").select("a", "b"), "scc", n=_rows())
            same, n, e = got["n"] == n, got["n"], t
            if same:
                break
        if not n:
            break
        colour = table(e.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("c"), F.lit(True).alias("moved")), "colour")
        while True:
            front = colour.where("moved").select(F.col("id").alias("a"), "c")
            offer = e.join(front, "a").groupBy(F.col("b").alias("id")).agg(F.min("c").alias("o"))
            better = F.coalesce(F.col("o") < F.col("c"), F.lit(False))
            nxt = colour.join(offer, "id", "left").select("id", F.when(better, F.col("o")).otherwise(F.col("c")).alias("c"), better.alias("moved"))
            nxt, got = measured(nxt, "colour", n=F.count_if("moved"))
            drop(colour)
            colour = nxt
            if not got["n"]:
                break
        ends = [colour.select(F.col("id").alias(k), F.col("c").alias(f"c{k}")) for k in "ab"]
        same = table(e.join(ends[0], "a").join(ends[1], "b").where("ca = cb").select("a", "b", F.col("ca").alias("c")), "same")
        front = table(colour.where("id = c").select("id", "c"), "back")
        back = _Seen(front)
        while True:
            new = same.join(front.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id"), "c").distinct().join(back.all(), "id", "left_anti")
            front, got = measured(new.select("id", "c"), "back", n=_rows())
            if not got["n"]:
                break
            back.add(front)
        settled = table(back.all(), "settled")
        done = settled if done is None else table(done.unionAll(settled), "done")
        gone = settled.select("id")
        e, got = measured(e.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"), "scc", n=_rows())
        n = got["n"]
    if done is None:
        return edges.sparkSession.createDataFrame([], "id string, component string")
    big = done.groupBy("c").agg(_rows().alias("n"), F.min("id").alias("component")).where("n > 1")
    return done.join(big, "c").select("id", "component")


def detect_cycles(g: Graph, top_n: int = 10, relations: tuple[str, ...] = DEPENDS) -> DataFrame:
    """One shortest cycle through the smallest node of each strongly connected set; severity 1 / length."""
    e = g.edges.where(F.col("relation").isin(*relations)).select("source", "target")
    scc = table(strong_components(e), "sets")
    inner = e.distinct().join(scc.select(F.col("id").alias("source"), F.col("component").alias("k")), "source").join(
        scc.select(F.col("id").alias("target"), F.col("component").alias("k2")), "target"
    )
    inner = table(inner.where("k = k2 and source <> target").select("k", "source", "target"), "inner")
    paths = table(inner.where("source = k").select("k", F.col("target").alias("id"), F.array("source", "target").alias("path")), "cycle")
    seen, found = _Seen(paths.select("k", "id")), None
    while True:
        hop = paths.join(inner.select("k", F.col("source").alias("id"), "target"), ["k", "id"])
        closed = hop.where("target = k").groupBy("k").agg(F.min("path").alias("path"))
        found = table(closed if found is None else found.unionAll(closed.join(found, "k", "left_anti")), "closed")
        new = hop.where("target <> k").groupBy("k", F.col("target").alias("id")).agg(F.min(F.concat("path", F.array("target"))).alias("path"))
        paths, got = measured(new.join(seen.all(), ["k", "id"], "left_anti").join(found.select("k"), "k", "left_anti").select("k", "id", "path"), "cycle", n=_rows())
        if not got["n"]:
            break
        seen.add(paths.select("k", "id"))
    return found.select(F.size("path").alias("length"), (1.0 / F.size("path")).alias("severity"), F.array_join("path", " > ").alias("cycle")).orderBy(F.desc("severity"), "cycle").limit(top_n)
