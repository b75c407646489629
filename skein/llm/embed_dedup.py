"""Embedding near-duplicates by cross-polytope hashing.

Vectors of equal label and length are compared by cosine.  Equal vectors are one
class with a count.  A class is hashed in ``TABLES`` tables: random signs and a
fast Hadamard transform, three times over, turn the vector, and the nearest
vertex of the cross-polytope (the largest coordinate and its sign) is the hash;
two such hashes make a bucket.  Multiprobe adds, in every table, the buckets of
the second-nearest vertex of either hash.  At the threshold a pair meets in some
bucket with a chance of about 0.998; tests measure recall against brute force.

Within a bucket all pairs are verified by their cosine in double precision, as
matrix products over tiles.  A pair that meets in several buckets counts once,
in the smallest of its common ones, so no list of pairs is ever made: a task
returns link counts and one edge per row.  Rows travel with their vector in its
own precision and those of their keys that are smaller than the bucket's.  A
bucket with more than ``CELL_ROWS`` classes is split into parts and each pair of
parts becomes a cell of its own.  Work per row grows with the links per row, as
every link is verified; nothing else does.

A class goes by its smallest vec_id (nulls last), so the smallest node of a
component is its answer and nothing is joined by component.

Defined results: a row whose label is null, or whose vector is null, empty, zero
or has null or non-finite components, links with nothing and stands alone; equal
rows link with each other; a null vec_id takes part but never names a
component; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.components import connected_components
from skein.plans.storage import table

COSINE = 0.93
TABLES = 5
HASHES = 2
CELL_ROWS = 4000
TILE_ROWS = 512
SEED = 11
#: What a class goes by; the order of its fields is the order of nodes.
NODE = "struct<none:boolean,vec_id:long,h1:long,h2:long>"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        x = x.reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def bucket_keys(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, seed: int = SEED) -> np.ndarray:
    """(rows, tables * (1 + hashes)) bucket numbers of unit vectors; equal numbers mean one bucket."""
    n, d = x.shape
    width = max(2, 1 << (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - d)))
    rng = np.random.default_rng(seed)
    keys = []
    for t in range(tables):
        near = []
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :2]
            near.append(2 * order + (np.take_along_axis(y, order, axis=1) < 0))
        for probe in range(1 + hashes):
            key = np.full(n, t, np.int64)
            for k in range(hashes):
                key = key * (2 * width) + near[k][:, int(probe == k + 1)]
            keys.append(key)
    return np.stack(keys, axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_width(lists) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, rows as a matrix) of the vectors of each width; ``lists`` is a list column without nulls."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    width = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(width):
        at = np.nonzero(width == d)[0]
        own = lists if len(at) == len(width) else lists.take(pa.array(at))
        out.append((at, own.flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(d))))
    return out


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = np.zeros((b.num_rows, TABLES * (1 + HASHES)), np.int64)
        for at, x in _by_width(b.column("embedding")):
            keys[at] = bucket_keys(_unit(x))
        lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("node", "grp", "copies", "embedding")], lists], ["node", "grp", "copies", "embedding", "keys"])


def _components(adj: np.ndarray) -> np.ndarray:
    lab = np.arange(len(adj), dtype=np.int32)
    big = np.int32(len(adj))
    while True:
        new = np.minimum(lab, np.where(adj, lab[None, :], big).min(axis=1))
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _met_before(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Which pairs of ``n`` rows have a key in common, from (row, key) pairs."""
    met = np.zeros((n, n), bool)
    by = np.argsort(keys, kind="stable")
    rows, keys = rows[by], keys[by]
    head = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(keys)))
    few = np.repeat(size, size) <= 8
    for step in range(1, 8):
        i = np.nonzero(few[:-step] & (keys[:-step] == keys[step:]))[0]
        met[rows[i], rows[i + step]] = met[rows[i + step], rows[i]] = True
    for a, k in zip(head[size > 8], size[size > 8]):
        own = rows[a : a + k]
        met[own[:, None], own] = True
    return met


def _compare(cosine: float):
    def links(t: pa.Table) -> pa.RecordBatch:
        """Link counts and local roots of rows that form whole cells."""
        number = lambda name: t.column(name).to_numpy()
        cell, part, copies = number("cell"), number("part"), number("copies").astype(np.float64)
        own_parts = number("same").astype(bool)
        n = len(cell)
        total, root = np.zeros(n, np.int64), np.arange(n)
        smaller = t.column("smaller").combine_chunks()
        held = np.repeat(np.arange(n), pa.compute.list_value_length(smaller).to_numpy(zero_copy_only=False))
        keys = smaller.flatten().to_numpy(zero_copy_only=False)
        for at, vectors in _by_width(t.column("embedding")):
            x, c = _unit(vectors), cell[at]
            close = np.zeros((len(at), len(at)), bool)
            for a in range(0, len(at), TILE_ROWS):
                e = min(a + TILE_ROWS, len(at))
                # Rows come by cell: a tile meets the rows of its own cells only.
                low, high = np.searchsorted(c, c[a], "left"), np.searchsorted(c, c[e - 1], "right")
                close[a:e, low:high] = (x[a:e] @ x[low:high].T >= cosine) & (c[a:e, None] == c[None, low:high])
            np.fill_diagonal(close, False)
            rows = np.nonzero(close.any(axis=1))[0]
            if not len(rows):
                continue
            close, mine = close[np.ix_(rows, rows)], at[rows]
            root[mine] = mine[_components(close)]
            place = np.full(n, -1)
            place[mine] = np.arange(len(mine))
            some = place[held] >= 0
            close &= ~_met_before(place[held[some]], keys[some], len(mine))
            for a in range(0, len(mine), TILE_ROWS):
                i = mine[a : a + TILE_ROWS]
                # A cell of two parts counts pairs across them; a part's own pairs count in its own cell.
                counts = close[a : a + TILE_ROWS] & (own_parts[i, None] | (part[i, None] != part[None, mine]))
                total[i] += (counts @ copies[mine]).astype(np.int64)
        seen = np.nonzero((total > 0) | (root != np.arange(n)))[0]
        node = t.column("node").combine_chunks()
        return pa.RecordBatch.from_arrays([node.take(pa.array(seen)), pa.array(total[seen]), node.take(pa.array(root[seen]))], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(upto: int | None):
            nonlocal held, rows
            t = pa.Table.from_batches(held)
            now = t if upto is None else t.slice(0, upto)
            held = [] if upto is None else t.slice(upto).combine_chunks().to_batches()
            rows = sum(b.num_rows for b in held)
            return links(now.combine_chunks())

        for b in batches:
            for a in range(0, b.num_rows, TILE_ROWS):
                held.append(b.slice(a, TILE_ROWS))
                rows += held[-1].num_rows
                if rows >= TILE_ROWS:
                    cells = np.concatenate([h.column("cell").to_numpy() for h in held])
                    if cells[0] != cells[-1]:
                        yield flush(int(np.nonzero(cells != cells[-1])[0][-1]) + 1)
        if rows:
            yield flush(None)

    return run


def class_of(label: Column, vector: Column) -> Column:
    """(h1, h2): a name for the class of rows equal in label and vector; null where a row may not link."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    name = F.struct(F.xxhash64(label, vector).alias("h1"), F.xxhash64(F.lit(SEED), label, vector).alias("h2"))
    return F.when(label.isNotNull() & vector.isNotNull() & F.coalesce(fine, F.lit(False)), name)


def link_counts(classes: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(node, links, root): links to other classes, in vectors, and edges, from (node, label, embedding, copies)."""
    kind = classes.schema["embedding"].dataType.simpleString()
    hashed = classes.select("node", F.xxhash64("label", F.size("embedding")).alias("grp"), "copies", "embedding").mapInArrow(
        _hash_batches, f"node {NODE}, grp long, copies long, embedding {kind}, keys array<long>"
    )
    # Bucket numbers of one label mean nothing under another.
    hashed = hashed.withColumn("keys", F.array_distinct(F.transform("keys", lambda k: F.xxhash64("grp", k)))).drop("grp")
    hashed = table(hashed, "hashed")
    dealt = hashed.select("node", F.explode("keys").alias("key"))
    shared = (
        dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.col("key").alias("s_key"), F.ceil(F.col("n") / cell_rows).cast("int").alias("parts"))
    )
    placed = dealt.join(shared, dealt.key == F.col("s_key")).select(
        "node", "key", "parts", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    )
    cells = placed.select(
        F.col("node").alias("p_node"), "key", "part", (F.col("part") == F.col("other")).alias("same"),
        F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("cell"),
    )
    smaller = F.filter("keys", lambda k: k < F.col("key")).alias("smaller")
    full = cells.join(hashed, cells.p_node == hashed.node).select("cell", "part", "same", "node", "copies", "embedding", smaller)
    return full.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(cosine), f"node {NODE}, links long, root {NODE}")


def near_duplicates(df: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``df`` (vec_id, embedding, label)."""
    vector = F.col("embedding")
    if df.schema["embedding"].dataType.simpleString() != "array<float>":  # narrower numbers would lose digits
        vector = vector.cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"), "label")
    rows = rows.withColumn("class", class_of(F.col("label"), F.col("embedding")))
    least = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id"))
    classes = rows.where("class is not null").groupBy("class.h1", "class.h2").agg(
        least.alias("low"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    classes = table(classes.select(F.struct("low.none", "low.vec_id", "h1", "h2").alias("node"), "copies", "label", "embedding"), "classes")
    found = table(link_counts(classes, cosine), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "l_node")
    comps = connected_components(found.where("root <> node"), "node", "root").withColumnRenamed("node", "c_node")
    c = classes.select("node", "copies").join(links, F.col("node") == F.col("l_node"), "left").join(comps, F.col("node") == F.col("c_node"), "left")
    answer = c.select(
        F.col("node.h1").alias("a_h1"), F.col("node.h2").alias("a_h2"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("a_links"),
        F.coalesce("component", "node")["vec_id"].alias("a_comp"),
    )
    comp = F.when(F.col("a_h1").isNull(), F.col("vec_id")).otherwise(F.col("a_comp"))
    return rows.join(answer, (F.col("class.h1") == F.col("a_h1")) & (F.col("class.h2") == F.col("a_h2")), "left").select(
        "vec_id", F.coalesce("a_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept")
    )


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op9_cross_polytope": op9_cross_polytope}
#: All pairs by their cosine; the index may miss a pair in a few hundred at the threshold itself.
ORACLES = {
    "op9_cross_polytope": """
WITH RECURSIVE p AS MATERIALIZED (
   SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
   WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93),
 own AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT vec_id, vec_id FROM embeddings),
 c(id, low, k) AS (SELECT vec_id, vec_id, 0 FROM embeddings UNION ALL SELECT own.b, min(low), k + 1 FROM c JOIN own ON c.id = own.a WHERE k < 12 GROUP BY own.b, k),
 r AS (SELECT id, min(low) AS component_id FROM c GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM p WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN r ON id = vec_id""",
}
