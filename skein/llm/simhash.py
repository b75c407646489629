"""SimHash near-duplicates by tiled exact comparison.

A fingerprint is the bitwise majority over the XXH64 hashes (seed 42) of a
text's 3-word shingles.  Two fingerprints link at ``RADIUS`` or fewer differing
bits; every such pair is found.

Distinct fingerprints are compared, so copies cost one row.  They are dealt by
block combinations: 64 bits fall into ``RADIUS + PICK`` blocks, and two
fingerprints within the radius agree on at least ``PICK`` whole blocks, so they
meet under one of the combinations.  Within a task the rows, sorted by
combination, key and population count, are cut into tiles; tiles are compared
by numpy exclusive-or and bit counts, and a pair of tiles is skipped when the
population counts of the key they share differ by more than the radius.  A tile
pair emits at most one edge per row (its local components), never all pairs.
A key with more than ``CELL_ROWS`` fingerprints is split by population count into
bands of ``RADIUS + 1``, of which only neighbours can hold a pair, and a band of
too many rows by hash; each pair of parts that may hold a pair becomes a cell of
its own, so no key has to fit one task.

A fingerprint goes by the smallest row that has it (doc_id, nulls last, then the
hash of the text), so the smallest node of a component is its answer and nothing
is joined by component.

Defined results: a null or blank text has fingerprint zero and links like any
other; fewer than three words are one shingle; repeated rows share a result; a
null doc_id gets a component but never names one (null if all its members are
null); of equal doc_ids the one with the smaller text hash stands for the group;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.columns import documents
from skein.plans.components import connected_components
from skein.plans.storage import table

RADIUS = 3
PICK = 2
TILE = 512
CELL_ROWS = 50_000
HOT_SHARE = 1000
HOT_PARTS = 64
SHINGLE = 3
SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    w = text.lower().split() if text else []
    if not w:
        return 0
    n = max(1, len(w) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    h64 = xxhash.xxh64_intdigest
    for a in range(0, n, _CHUNK):
        part = w[a : a + _CHUNK + SHINGLE - 1]
        grams = zip(part, part[1:], part[2:]) if len(w) >= SHINGLE else [w]
        h = np.fromiter((h64(b" ".join(g), SEED) for g in grams), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        fps = np.fromiter((fingerprint(texts[i].as_py()) for i in range(len(texts))), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp) per row; fp is the fingerprint as a signed long."""
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key, "text")
    return d.mapInArrow(_fingerprint_batches, "doc_id long, text_key long, fp long")


def _block_keys(fp: Column, radius: int, pick: int) -> Column:
    blocks = radius + pick
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    signed = [sum(masks[i] for i in c) for c in itertools.combinations(range(blocks), pick)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in signed]
    return F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(signed)])


#: What a fingerprint goes by; the order of its fields is the order of nodes.
NODE = "struct<none:boolean,doc_id:long,text_key:long,fp:long>"


def _local_edges(fp: np.ndarray, at: np.ndarray, adj: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the symmetric adjacency: (row, its centre), as places in the tile's rows."""
    lab = np.arange(len(fp))
    big = len(fp)
    while True:
        new = np.minimum(lab, np.where(adj, lab[None, :], big).min(axis=1))
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    i = np.nonzero(lab != np.arange(len(fp)))[0]
    return at[i], at[lab[i]]


def _tile_edges(fp: np.ndarray, a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Edges among the rows at ``a`` of ``fp``, or between those at ``a`` and those at ``b``."""
    x = fp[a]
    if b is None:
        adj = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
        rows = np.nonzero(adj.sum(axis=1) > 1)[0]
        if not len(rows):
            return None
        return _local_edges(x[rows], a[rows], adj[np.ix_(rows, rows)])
    y = fp[b]
    cross = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
    ra, rb = np.nonzero(cross.any(axis=1))[0], np.nonzero(cross.any(axis=0))[0]
    if not len(ra):
        return None
    sub = cross[np.ix_(ra, rb)]
    adj = np.zeros((len(ra) + len(rb),) * 2, bool)
    adj[: len(ra), len(ra) :] = sub
    adj[len(ra) :, : len(ra)] = sub.T
    return _local_edges(np.concatenate([x[ra], y[rb]]), np.concatenate([a[ra], b[rb]]), adj)


def _compare_tiles(radius: int, tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old: list[tuple[int, pa.RecordBatch]] = []  # (largest population count, rows of the open cell) of earlier tiles
        pending: pa.Table | None = None

        def edges(rows: pa.Table, a: np.ndarray, b: np.ndarray | None, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = _tile_edges(fp, a, b, radius)
            if found is not None:
                ends = [rows.take(pa.array(f)).column("node").combine_chunks() for f in found]
                ends = [e.chunk(0) if isinstance(e, pa.ChunkedArray) else e for e in ends]
                yield pa.RecordBatch.from_arrays(ends, ["src", "dst"])

        def emit(now: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal old
            n = now.num_rows
            rows = pa.Table.from_batches([now])
            cell, fp = now.column("cell").to_numpy(), now.column("fp").to_numpy().view(np.uint64)
            # All rows of the tile meet: a pair within the radius is one whatever cells its rows come from.
            yield from edges(rows, np.arange(n), None, fp)
            cuts = np.concatenate([[0], np.nonzero(cell[1:] != cell[:-1])[0] + 1, [n]])
            if old and old[0][1].column("cell")[0].as_py() != cell[0]:
                old = []
            front = cuts[1]
            low = int(np.bitwise_count(fp[:1])[0])  # rows of a cell come by population count
            for high, before in old:
                if low - high <= radius:
                    both = pa.Table.from_batches([before, now.slice(0, front)])
                    k = before.num_rows
                    every = both.column("fp").to_numpy().view(np.uint64)
                    yield from edges(both, np.arange(k), np.arange(k, k + front), every)
            if cell[-1] != cell[0]:
                old = []
            back = now.slice(cuts[-2])
            last = np.bitwise_count(fp[-1:])[0]
            old = [x for x in old if int(last) - x[0] <= radius] + [(int(last), back)]

        for b in batches:
            pending = pa.Table.from_batches([b]) if pending is None else pa.concat_tables([pending, pa.Table.from_batches([b])])
            whole = pending.num_rows - pending.num_rows % tile
            for a in range(0, whole, tile):
                yield from emit(pending.slice(a, tile).combine_chunks().to_batches()[0])
            pending = pending.slice(whole)
        if pending is not None and pending.num_rows:
            yield from emit(pending.combine_chunks().to_batches()[0])

    return run


def fingerprint_edges(distinct_fp: DataFrame, radius: int = RADIUS, pick: int = PICK, tile: int = TILE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (src, dst) of nodes whose components are those of all pairs within ``radius``; from rows of (fp, node)."""
    dealt = distinct_fp.select("fp", "node", F.explode(_block_keys(F.col("fp"), radius, pick)).alias("k")).select("fp", "node", "k.t", "k.key")
    band = F.floor(F.bit_count("fp") / (radius + 1)).cast("int")
    heavy = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows).select(F.col("t").alias("ht"), F.col("key").alias("hkey"))
    # A heavy key has a row of at most 64 / (radius + 1) + 1 bands with the number of parts of each.
    parts = (
        dealt.join(heavy, (F.col("t") == F.col("ht")) & (F.col("key") == F.col("hkey")))
        .groupBy("t", "key", band.alias("band")).agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("parts"))
        .groupBy(F.col("t").alias("lt"), F.col("key").alias("lkey")).agg(F.map_from_entries(F.collect_list(F.struct("band", "parts"))).alias("parts"))
    )
    placed = dealt.join(parts, (F.col("t") == F.col("lt")) & (F.col("key") == F.col("lkey")), "left").withColumn("band", band)
    name = lambda b, p: b.cast("long") * (1 << 40) + p
    own = name(F.col("band"), F.pmod(F.xxhash64("fp"), F.coalesce(F.col("parts")[F.col("band")], F.lit(1))))
    near = F.flatten(
        F.transform(
            F.filter(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1), lambda b: F.map_contains_key("parts", b)),
            lambda b: F.transform(F.sequence(F.lit(0), F.col("parts")[b] - 1), lambda p: name(b, p)),
        )
    )
    whole = F.array(F.lit(-1).cast("long"))
    cells = placed.select("fp", "node", "t", "key", F.when(F.col("parts").isNull(), F.lit(-1)).otherwise(own).alias("p"), F.explode(F.when(F.col("parts").isNull(), whole).otherwise(near)).alias("o"))
    cells = cells.select("fp", "node", F.xxhash64("t", "key", F.least("p", "o"), F.greatest("p", "o")).alias("cell"), F.bit_count("fp").alias("pop"))
    return (
        cells.repartition("cell")
        .sortWithinPartitions("cell", "pop", "fp")
        .select("cell", "fp", "node")
        .mapInArrow(_compare_tiles(radius, tile), f"src {NODE}, dst {NODE}")
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_key, fp, component_id, rep_key) per row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach; the row with that
    doc_id and the text hash ``rep_key`` stands for the component.
    """
    fps = table(fingerprints(docs), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    distinct = fps.groupBy("fp").agg(least.alias("b"), F.count(F.lit(1)).alias("n"))
    distinct = table(distinct.select("fp", "n", F.struct("b.none", "b.doc_id", "b.text_key", "fp").alias("node")), "distinct")
    comps = connected_components(fingerprint_edges(distinct, radius)).select(F.col("node.fp").alias("c_fp"), "component")
    # Fingerprints of more than 1 / HOT_SHARE of all rows, fewer than HOT_SHARE: their rows are dealt over parts.
    total = distinct.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(distinct.where(F.col("n") * HOT_SHARE > total).select(F.col("fp").alias("h_fp")))
    named = distinct.join(comps, F.col("fp") == F.col("c_fp"), "left").join(hot, F.col("fp") == F.col("h_fp"), "left").select(
        F.col("fp").alias("n_fp"), F.coalesce("component", "node").alias("top"),
        F.explode(F.sequence(F.lit(0), F.when(F.col("h_fp").isNull(), 0).otherwise(HOT_PARTS - 1))).alias("n_part"),
    )
    part = F.when(F.col("h_fp").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(HOT_PARTS)).cast("int"))
    rows = fps.join(hot, F.col("fp") == F.col("h_fp"), "left").withColumn("part", part)
    return rows.join(named, (F.col("fp") == F.col("n_fp")) & (F.col("part") == F.col("n_part"))).select(
        "doc_id", "text_key", "fp", F.col("top.doc_id").alias("component_id"), F.col("top.text_key").alias("rep_key")
    )


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component, one row each."""
    reps = (
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("rep_key")))
        .select(F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key"))
        .distinct()
    )
    keyed = docs.withColumn("_text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    out = keyed.join(reps, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("_text_key") == F.col("r_key")), "left_semi")
    return out.dropDuplicates(["doc_id", "_text_key"]).select(*docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


QUERIES = {"op6_simhash": op6_simhash}
ORACLES: dict[str, str] = {}
