"""Sharding by sampled splitters: shards of near-equal bytes.

A size-weighted, hash-driven sample of record keys gives quantile boundaries,
and records are range-partitioned by them into many more ranges than shards.
The exact bytes of every range are then counted; ranges that hold too much are
subdivided with splitters from a denser sample of their own.  Range totals put
every range at its exact offset, so a record's shard follows from the bytes
before it, whatever the sample was: shards differ by less than one record.

The key is a hash of the text, then doc_id.  Equal texts lie side by side and
share a shard unless a boundary must fall among them; a text that a third of
all rows hold is spread by doc_id.

Only (doc_id, size, checksum, key) travels.  The driver sees the sample and one
row per range; ranges number ``RANGES_PER_SHARD`` per shard or one per
``RANGE_ROWS`` rows, whichever is more.

Defined results: a null text has size 8 and the checksum of the empty string; a
null doc_id sorts first; repeated rows are separate records; an empty table
gives no rows.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.columns import documents
from skein.plans.storage import table

SHARDS = 24
RANGES_PER_SHARD = 8
RANGE_ROWS = 500_000
SAMPLES_PER_RANGE = 20
OVERFULL = 2.0
#: Rounds of subdividing; what is still overfull then costs time, not correctness.
DEEPEST = 5
_NO_ID = -(1 << 63)


def records(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID).cast("long")).alias("tie"),
    )


def _sample(recs: DataFrame, total: int, draws: int, salt: int) -> list[tuple[int, int, int]]:
    """About ``draws`` draws of (key, tie) with chances in proportion to size."""
    u = F.shiftrightunsigned(F.xxhash64("key", "tie", F.lit(salt)), 11) / F.lit(float(1 << 53))
    hits = F.floor(F.col("size") * F.lit(draws / max(1, total)) + u).cast("long")
    got = recs.select("key", "tie", hits.alias("n")).where("n > 0").collect()
    return sorted((r.key, r.tie, r.n) for r in got)


def _quantiles(sample: list[tuple[int, int, int]], ranges: int) -> list[tuple[int, int]]:
    if not sample:
        return []
    cum = np.cumsum([n for *_, n in sample])
    at = np.searchsorted(cum, cum[-1] * np.arange(1, ranges) / ranges)
    return sorted({sample[i][:2] for i in at})


def _range_of(splitters: list[tuple[int, int]]):
    """A vectorised function from (key, tie) to the number of splitters at or below it."""
    keys = np.array([k for k, _ in splitters], np.int64)
    ties = np.array([t for _, t in splitters], np.int64)

    @F.pandas_udf("int")
    def run(key: pd.Series, tie: pd.Series) -> pd.Series:
        k, t = key.to_numpy(np.int64), tie.to_numpy(np.int64)
        lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        out = hi.copy()
        for i in np.nonzero(hi > lo)[0]:
            out[i] = lo[i] + np.searchsorted(ties[lo[i] : hi[i]], t[i], "right")
        return pd.Series(out.astype(np.int32))

    return run


def _subdivide(ranged: DataFrame, splitters: list, full: dict[int, int], stats: dict, salt: int) -> list[tuple[int, int]]:
    """Further splitters inside the overfull ranges ``full`` (range to number of parts)."""
    if not full:
        return []
    inside = ranged.where(F.col("range").isin(list(full)))
    sample = _sample(inside, sum(stats[r][0] for r in full), sum(full.values()) * SAMPLES_PER_RANGE, salt)
    by_range: dict[int, list[tuple[int, int, int]]] = {}
    for key, tie, n in sample:
        by_range.setdefault(bisect.bisect_right(splitters, (key, tie)), []).append((key, tie, n))
    return [s for r, own in by_range.items() for s in _quantiles(own, full.get(r, 2))]


def shard(docs: DataFrame, shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row of ``docs``."""
    spark = docs.sparkSession
    recs = table(records(docs), "records")
    rows, total = recs.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(shards * ranges_per_shard, math.ceil(rows / range_rows))
    splitters = _quantiles(_sample(recs, total, ranges * SAMPLES_PER_RANGE, 0), ranges)

    limit = OVERFULL * max(total / ranges, 1)
    for deeper in range(1, DEEPEST + 1):
        ranged = recs.withColumn("range", _range_of(splitters)("key", "tie"))
        per_range = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        stats = {r.range: (r.bytes, r.n) for r in per_range}
        full = {r: math.ceil(2 * b / limit) for r, (b, n) in stats.items() if b > limit and n > 1}
        more = {} if deeper == DEEPEST else _subdivide(ranged, splitters, full, stats, deeper)
        if not set(more) - set(splitters):
            break
        splitters = sorted({*splitters, *more})

    offsets, before_bytes, before_rows = [], 0, 0
    for r in sorted(stats):
        offsets.append((r, before_bytes, before_rows))
        before_bytes, before_rows = before_bytes + stats[r][0], before_rows + stats[r][1]
    # One row per range, a number fixed above.
    at = F.broadcast(spark.createDataFrame(offsets, "range int, b0 long, r0 long"))
    w = Window.partitionBy("range").orderBy("key", "tie")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Twice the middle of the record, in units of total / shards: integers only.
    middle = 2 * (F.col("b0") + F.sum("size").over(run)) - F.col("size")
    placed = ranged.join(at, "range").select(
        "doc_id", "size", "text_crc32", middle.alias("mid"), (F.col("r0") + F.row_number().over(w) - 1).alias("at")
    )
    number = F.expr(f"cast(least({shards - 1}, (mid * {shards}) div {max(1, 2 * total)}) as int)")
    placed = table(placed.select("doc_id", "size", "text_crc32", number.alias("shard"), F.col("at").cast("long")), "placed")
    starts = F.broadcast(placed.groupBy("shard").agg(F.min("at").alias("start")))  # one row per shard
    return placed.join(starts, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("start")).alias("slot"))


def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op3_sampled_splitters": op3_sampled_splitters}
ORACLES: dict[str, str] = {}
