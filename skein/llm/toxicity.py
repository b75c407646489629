"""Toxicity scores by a factorization machine over hashed terms.

A document's terms are the distinct lower-case words of its whole text and their
leading ``STEMS`` letters, hashed into ``2**HASH_BITS`` columns.  The machine

    score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>)

learns a weight for each term and, through factors, one for each pair of terms,
such as an insult together with a group name, which additive weights miss.

It is fitted on the driver by AdaGrad on at most ``TRAIN_ROWS`` labelled rows,
those with the smallest hash of doc_id among the rows whose ``crc32(doc_id) mod
4`` is not 2 (rows repeated under one doc_id count each, so the bound holds
whatever is repeated); only their hashed terms travel, four bytes each, and of
these only the columns that enter the model: counts are made in Spark.  Every column that ``LEAST_DOCS`` of
these rows hold, and not all of them, enters the model, which ``2**HASH_BITS``
bounds: a term may tell something only together with another, so none is left
out for what it tells alone.  Instead weights pay for their size (an absolute
penalty for w, a squared one for v, each by the square root of the column's share
of the rows, the noise of its gradient).  The weights are fitted first, then
weights and factors together on what they leave.
Scoring is one pass of Arrow batches over all documents.

Labels, language, source and doc_id are never inputs of a score.

Defined results: a null or blank text scores sigmoid(w0); repeated labels of a
doc_id count as toxic if one is; null labels are left out; without labels of
both classes the score is the smoothed share of toxic labels; a null doc_id is
not held out; rows that tie under one doc_id are taken by their terms; other
columns are ignored; an empty table of documents gives no rows, one of labels the
share 1/2.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.columns import documents
from skein.plans.storage import table

HASH_BITS = 20
STEMS = (4, 5, 6)
TRAIN_ROWS = 30_000
LEAST_DOCS = 3
FACTORS = 8
EPOCHS = 25
BATCH = 256
RATE = 0.1
#: Penalties of |w| and of v squared, times sqrt(share of the rows / rows).
W_PENALTY = 0.3
V_PENALTY = 3.0
#: A step of w, of v, moves the scores of its rows by at most this much (root mean square).
W_MOVE = 10.0
V_MOVE = 0.3
#: The training rows reach the driver in so many parts; so many bytes of a row are compared first.
PARTS = 16
PREFIX = 64
SEED = 5
HELD_OUT = 2
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
_MASK = (1 << HASH_BITS) - 1


def term_columns(text: str | None) -> np.ndarray:
    """The distinct hashed columns of a text, ascending."""
    found = set(_WORD.findall(text.lower())) if text else set()
    terms = found | {"^" + w[:k] for k in STEMS for w in found if len(w) > k}
    return np.unique(np.fromiter((zlib.crc32(t.encode()) & _MASK for t in terms), np.int32, len(terms)))


@dataclass
class Machine:
    """w0, and for each chosen column its weight and factors."""

    columns: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def place(self) -> np.ndarray:
        """Hashed column to model row, -1 where the model has none."""
        at = np.full(1 << HASH_BITS, -1, np.int32)
        at[self.columns] = np.arange(len(self.columns))
        return at

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        """The scores before the sigmoid, from model rows of each document."""
        return _forward(self.w0, self.w, self.v, rows)[0]


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = [len(r) for r in rows]
    return np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64), np.repeat(np.arange(len(rows)), lengths)


def _by_doc(x: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``x`` per document; ``doc`` ascends."""
    out = np.zeros((n, *x.shape[1:]))
    if len(doc):
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        out[doc[first]] = np.add.reduceat(x, first, axis=0)
    return out


def _forward(w0, w, v, rows):
    term, doc = _flat(rows)
    factors = v[term]
    sums = _by_doc(factors, doc, len(rows))
    squares = _by_doc(np.einsum("ij,ij->i", factors, factors), doc, len(rows))
    linear = np.bincount(doc, w[term], len(rows))
    return w0 + linear + 0.5 * ((sums**2).sum(axis=1) - squares), term, doc, sums


class _Batch:
    """Which of a batch's columns its rows hold; vectors are summed one at a time, so they stay in the cache.

    All places are valid; the mode ``wrap`` only spares their check.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, n: int, width: int):
        self.term, self.doc, self.n, self.width = term, doc, n, width
        self.first = np.flatnonzero(np.diff(doc, prepend=-1))
        self.filled = doc[self.first]

    def by_row(self, x: np.ndarray) -> np.ndarray:
        """Sums of ``x`` over the columns that each row holds."""
        out = np.zeros(self.n)
        if len(self.first):
            out[self.filled] = np.add.reduceat(x.take(self.term, mode="wrap"), self.first)
        return out

    def by_column(self, z: np.ndarray) -> np.ndarray:
        """Sums of ``z`` over the rows that hold each column."""
        return np.bincount(self.term, z.take(self.doc, mode="wrap"), self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def usable_columns(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The columns that enter, ascending, and how many rows hold each."""
    docs = np.zeros(1 << HASH_BITS, np.int64)
    for r in rows:
        docs[r] += 1
    columns = np.flatnonzero((docs >= LEAST_DOCS) & (docs < len(rows)))
    return columns, docs[columns]


def _placed(rows: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    """The model rows of each document, all in one array."""
    flat, ends = np.empty(sum(map(len, rows)), np.int32), [0]
    for r in rows:
        k = at[r]
        k = k[k >= 0]
        flat[ends[-1] : ends[-1] + len(k)] = k
        ends.append(ends[-1] + len(k))
    return [flat[a:z] for a, z in pairwise(ends)]


def in_order(flat: bytes | bytearray, ends: list[int], toxic: list[int]) -> list[int]:
    """The order of the rows by (bytes, toxic); whole rows are copied only where ``PREFIX`` bytes tie."""
    begins = lambda i: bytes(flat[ends[i] : min(ends[i] + PREFIX, ends[i + 1])])
    out: list[int] = []
    for _, tied in groupby(sorted(range(len(toxic)), key=begins), key=begins):
        out += sorted(tied, key=lambda i: (bytes(flat[ends[i] : ends[i + 1]]), toxic[i]))
    return out


def _within(move: np.ndarray, most: float) -> float:
    """The share of a step that moves scores by ``most`` at the root mean square."""
    return min(1.0, most / np.sqrt((move**2).mean() + 1e-12))


def fit(rows: list[np.ndarray], y: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS) -> Machine:
    """A machine from hashed columns and labels (0 or 1)."""
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    w0 = float(np.log(share / (1 - share)))
    columns, docs = usable_columns(rows) if 0 < y.sum() < n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    rng = np.random.default_rng(SEED)
    w, v = np.zeros(len(columns)), rng.normal(0, 0.01, (len(columns), factors))
    model = Machine(columns, w0, w, v)
    if not len(columns):
        return model
    at = model.place()
    rows = _placed(rows, at)
    noise = np.sqrt(docs) / n
    back_of = np.zeros(len(columns), np.int64)
    g0, gw = 1e-8, np.full_like(w, 1e-8)
    vs = [x.copy() for x in v.T]  # one vector a factor
    gvs = [np.full_like(x, 1e-8) for x in vs]
    for epoch in range(2 * epochs if factors else epochs):
        pairs = epoch >= epochs
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            part = order[a : a + BATCH]
            term, doc = _flat([rows[i] for i in part])
            used = np.flatnonzero(np.bincount(term, minlength=len(w)))
            back_of[used] = np.arange(len(used))
            batch = _Batch(back_of.take(term, mode="wrap"), doc, len(part), len(used))
            old = w.take(used)
            owns = [x.take(used) for x in vs] if pairs else []
            sums = [batch.by_row(own) for own in owns]
            squares = batch.by_row(sum(own * own for own in owns)) if pairs else 0.0
            margin = w0 + batch.by_row(old) + 0.5 * (sum(x * x for x in sums) - squares)
            err = (sigmoid(margin) - y[part]) / len(part)
            g = err.sum()
            g0 += g * g
            w0 -= RATE * g / np.sqrt(g0)
            if not len(term):
                continue
            dw = batch.by_column(err)
            gw[used] = seen = gw.take(used) + dw**2
            rate = RATE / np.sqrt(seen)
            rate *= _within(batch.by_row(rate * dw), W_MOVE)
            moved = old - rate * dw
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - rate * W_PENALTY * noise.take(used), 0)
            if not pairs:
                continue
            pull = V_PENALTY * noise.take(used) - dw
            steps, single, move = [], 0.0, 0.0
            for own, total, gv in zip(owns, sums, gvs):
                dv = batch.by_column(err * total) + pull * own
                gv[used] = seen = gv.take(used) + dv * dv
                step = RATE * dv / np.sqrt(seen)
                # The change of half of (squared sums less sums of squares).
                change = batch.by_row(step)
                move = move + (total - 0.5 * change) * change
                single = single + step * (own - 0.5 * step)
                steps.append(step)
            scale = _within(move - batch.by_row(single), V_MOVE)
            for x, own, step in zip(vs, owns, steps):
                x[used] = own - scale * step
    v = np.stack(vs, axis=1) if vs else v
    return Machine(columns, float(w0), w, v)


def held_out(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4) == HELD_OUT


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = b.column("text")
        terms = [term_columns(text[i].as_py()) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("h"), b.column("toxic"), pa.array(terms, pa.list_(pa.int32()))], ["h", "toxic", "terms"])


def _only(columns: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(1 << HASH_BITS, bool)
        kept[columns] = True
        for b in batches:
            rows = b.column("terms")
            terms = [(x := rows[i].values.to_numpy())[kept[x]].tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(terms, pa.binary())], ["toxic", "terms"])

    return run


def train(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS) -> Machine:
    """Fit on the labelled rows that are not held out, ``most_rows`` at most."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("l_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("l_id"), "l_id").limit(most_rows)
    )
    # At most ``most_rows`` rows of two numbers; again at most so many after the join, whatever is repeated.
    texts = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("l_id")).select("l_id", "toxic", "text")
    hashed = texts.select(F.xxhash64("l_id").alias("h"), "toxic", "text").mapInArrow(_terms_of, "h long, toxic int, terms array<int>")
    terms = table(hashed.orderBy("h", F.xxhash64("terms"), "toxic").limit(most_rows), "terms")
    held = terms.select(F.explode("terms").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_DOCS)
    keep = np.sort(held.select("c").toArrow().column("c").to_numpy())  # at most 2**HASH_BITS
    # One partition's rows at a time pass through the driver's JVM; here they go to the end of one buffer.
    flat, ends, toxic = bytearray(), [0], []
    for r in terms.repartition(PARTS).mapInArrow(_only(keep), "toxic int, terms binary").toLocalIterator():
        flat += r.terms
        ends.append(len(flat))
        toxic.append(r.toxic)
    order = in_order(flat, ends, toxic)
    every = np.frombuffer(flat, np.int32)
    rows = [every[ends[i] // 4 : ends[i + 1] // 4] for i in order]
    return fit(rows, np.array([float(toxic[i] > 0) for i in order]))


def _score_with(model: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = model.place()
        for b in batches:
            text = b.column("text")
            scores = np.zeros(b.num_rows)
            for a in range(0, b.num_rows, BATCH):
                part = range(a, min(a + BATCH, b.num_rows))
                rows = [(k := at[term_columns(text[i].as_py())])[k >= 0] for i in part]
                scores[a : a + len(part)] = sigmoid(model.margins(rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores)], ["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    out = d.mapInArrow(_score_with(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op8_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op8_factorization_machine": op8_factorization_machine}
ORACLES: dict[str, str] = {}
