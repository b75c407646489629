"""Node vectors from walks: the expected contexts of random walks, projected on random signs.

A walk's context is what lies within ``window`` steps of a node.  Its expectation
needs no walks: it is the sum of the first powers of the step matrix, applied here
to a random sign vector per node.  A round is one join and one map-side sum by
(node, coordinate), so a hub's neighbours are never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.graph import Graph
from skein.operators.resolve import similar_pairs
from skein.plans.storage import table

DIM = 64
WINDOW = 5


def walk_vectors(g: Graph, dim: int = DIM, window: int = WINDOW) -> DataFrame:
    """(id, vector): unit vectors of ``dim`` coordinates for every node that has an edge."""
    steps = g.und().where("id <> other").groupBy("id", "other").agg(F.sum("weight").alias("w"))
    total = steps.groupBy("id").agg(F.sum("w").alias("t"))
    steps = table(steps.join(total, "id").select("id", "other", (F.col("w") / F.col("t")).alias("p")), "walk")
    coordinate = F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("k")
    sign = F.when(F.pmod(F.xxhash64("id", "k"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    now = table(g.nodes.select("id", coordinate).select("id", "k", sign.alias("x")), "signs")
    every = None
    for _ in range(window):
        near = steps.join(now.withColumnRenamed("id", "other"), "other")
        now = table(near.groupBy("id", "k").agg(F.sum(F.col("p") * F.col("x")).alias("x")), "context")
        every = now if every is None else every.unionAll(now)
    summed = every.groupBy("id", "k").agg(F.sum("x").alias("x"))
    vector = F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"])  # dim rows a node
    v = summed.groupBy("id").agg(vector.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return v.select("id", F.transform("v", lambda x: x / F.greatest(norm, F.lit(1e-300))).alias("vector"))


def find_similar(g: Graph, top_n: int = 10, least: float = 0.5, dim: int = DIM, window: int = WINDOW) -> DataFrame:
    """(a, b, similarity): the pairs of nodes with the most alike walks, by cosine; no edge between them is needed."""
    v = table(walk_vectors(g, dim, window).withColumn("key", F.monotonically_increasing_id()), "vectors")
    found = similar_pairs(v, "key", "vector", least, top_n)
    name = lambda c: v.select(F.col("key").alias(c), F.col("id").alias(f"{c}_id"))
    ids = found.join(name("a"), "a").join(name("b"), "b")
    return ids.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "similarity").orderBy(F.desc("similarity"), "a", "b")
