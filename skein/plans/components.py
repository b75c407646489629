"""Connected components over an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.storage import drop, table


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge; component = smallest node.

    Alternates the large-star and small-star steps (Kiveris et al., 2014), which
    converge in O(log^2 n) rounds with linear traffic: a round aggregates by node
    and joins back, so a hub never has its neighbour list gathered in one task.
    Nulls in either end and self-loops are ignored.  An empty input gives no rows.
    """
    e = (
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    cur = table(e, "cc")
    seen = None
    for _ in range(max_rounds):
        # Large star: each node hands its larger neighbours to its smallest neighbour-or-self.
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node hands its smaller neighbours and itself to the smallest of them.
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .unionAll(low2.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        nxt = table(small, "cc")
        sig = nxt.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            F.bit_xor(F.xxhash64("v", "u")),
        ).first()
        drop(cur)
        cur = nxt
        if tuple(sig) == seen:
            break
        seen = tuple(sig)
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionAll(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
