"""Byte-level BPE encoding and decoding by recursive queries in DuckDB.

The merge table has one row for each pair of tokens whose bytes, joined, are a
token; its rank is that token's rank.  A batch of documents is cut into pieces
by the tokenizer's pattern, and each distinct piece becomes token-position rows,
one per byte, in an in-memory DuckDB of the partition.  A recursive query joins
neighbouring rows with the merge table and contracts every piece's leftmost pair
of minimum rank until no piece has a pair left; an ordered aggregation of token
bytes decodes the result.

Pieces repeat, so a worker keeps the encodings it has used lately (two
generations of ``CACHE_PIECES``, the older one packed) and asks DuckDB for new
ones only.

A recursive query keeps the rows of all its rounds, so it runs in slices of at
most ``SLICE_ROWS`` rows: a slice ends after so many rounds and the next starts
from its last.  A piece of more than ``LONG_PIECE`` bytes would need a round for
each of its merges; there a round of the recursive query contracts every separate
pair of the piece's minimum rank, left to right.  The outcome is the same if
joining a pair never makes one of a lower rank, which :func:`rounds_may_join`
proves for a vocabulary: a token T that a new pair could make at a lower rank than
that of the pair just joined would, at that rank, be one token already.  (What
the lower ranks make of a stretch whose ends are token borders depends on the
stretch alone, so it is enough to look at T's own bytes.)  For a vocabulary
without that property long pieces contract one pair a round like all others.

Memory is bounded by one document, the cache and one slice.  With a ``share`` of s
cache, batches and slices are s times smaller and the result is the same: for workers
whose executor keeps what other stages have grown.  DuckDB may spill
what exceeds its limit to the worker's own TMPDIR and removes it.  A lost executor
repeats its partitions; nothing is kept between tasks but caches.

Defined results: a null text is encoded as the empty text (no tokens, hash of
the empty string); repeated rows are encoded each; of pairs with equal rank the
leftmost is first; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from skein.llm.columns import documents

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_PIECES = 300_000
NEW_PIECES = 20_000
BATCH_CHARS = 2_000_000
LONG_PIECE = 64
PIECE_BYTES = 1_000_000
SLICE_ROWS = 16_000_000

_LEFTMOST = """
    WITH least AS (
        SELECT l.piece, min(m.rank::BIGINT * 4294967296 + l.pos) AS packed
        FROM parts l
        JOIN parts r ON l.piece = r.piece AND r.pos = l.pos + 1
        JOIN merges m ON m.pair = l.tok::BIGINT * 65536 + r.tok
        GROUP BY l.piece
    )
    SELECT p.piece,
           (p.pos - (p.pos > packed % 4294967296)::INT)::INT,
           (CASE WHEN p.pos = packed % 4294967296 THEN packed // 4294967296 ELSE p.tok END)::INT,
           round + 1
    FROM parts p JOIN least ON p.piece = least.piece
    WHERE p.pos <> packed % 4294967296 + 1 AND round < {rounds}
"""
_EVERY_SEPARATE = """
    WITH pairs AS (
        SELECT p.*, m.rank, min(m.rank) OVER (PARTITION BY piece) AS best
        FROM (SELECT *, lead(tok) OVER (PARTITION BY piece ORDER BY pos) AS nxt FROM parts) p
        LEFT JOIN merges m ON m.pair = p.tok::BIGINT * 65536 + p.nxt
    ), hits AS (
        SELECT *, coalesce(rank = best, false) AND (pos - coalesce(max(CASE WHEN rank IS DISTINCT FROM best THEN pos END)
                  OVER (PARTITION BY piece ORDER BY pos), -1)) % 2 = 1 AS hit
        FROM pairs WHERE best IS NOT NULL
    ), swallows AS (
        SELECT *, lag(hit, 1, false) OVER (PARTITION BY piece ORDER BY pos) AS swallowed FROM hits
    )
    SELECT piece, (row_number() OVER (PARTITION BY piece ORDER BY pos) - 1)::INT, (CASE WHEN hit THEN rank ELSE tok END)::INT, round + 1
    FROM swallows WHERE NOT swallowed AND round < {rounds}
"""
_SLICE = """
CREATE OR REPLACE TEMP TABLE {into} AS
WITH RECURSIVE parts(piece, pos, tok, round) AS (
    SELECT piece, pos, tok, 0 FROM {start}
  UNION ALL ({round})
)
SELECT piece, pos, tok, round FROM parts JOIN (SELECT piece, max(round) AS round FROM parts GROUP BY piece) USING (piece, round)
"""
_RESULT = """
SELECT piece, string_agg(tok::VARCHAR, ',' ORDER BY pos) AS ids, string_agg(hex, '' ORDER BY pos) AS decoded
FROM {parts} JOIN vocab USING (tok) GROUP BY piece
"""


@functools.lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


def rounds_may_join(of: dict[bytes, int]) -> bool:
    """Whether joining pairs rank by rank never makes a pair of a lower rank (see the module's text)."""

    def lower_ranks(raw: bytes, below: int) -> int:
        """How many tokens the ranks under ``below`` leave, each rank once, left to right."""
        t, last = [raw[i : i + 1] for i in range(len(raw))], -1
        while True:
            now = min((q for a, b in zip(t, t[1:]) if (q := of.get(a + b)) is not None and last < q < below), default=None)
            if now is None:
                return len(t)
            out: list[bytes] = []
            i = 0
            while i < len(t):
                step = 2 if i + 1 < len(t) and of.get(t[i] + t[i + 1]) == now else 1
                out.append(b"".join(t[i : i + step]))
                i += step
            t, last = out, now

    for token, rank in of.items():
        for i in range(1, len(token)):
            sides = token[:i], token[i:]
            if all(x in of for x in sides):
                for x in sides:
                    if of[x] > rank and len(x) > 1 and lower_ranks(token, of[x]) > 1:
                        return False
    return True


@functools.lru_cache(maxsize=2)
def _proved(path: str) -> bool:
    return rounds_may_join(ranks(path))


def _packed(hit: tuple[str, bytes]) -> bytes:
    """Ids and decoded bytes in one object; ids hold no ``|``."""
    return hit[0].encode() + b"|" + hit[1]


def _unpacked(packed: bytes) -> tuple[str, bytes]:
    ids, _, decoded = packed.partition(b"|")
    return ids.decode(), decoded


class Codec:
    """An in-memory DuckDB with the vocabulary, and the pieces used lately."""

    def __init__(self, path: str, pattern: str, long_piece: int = LONG_PIECE, share: int = 1):
        of = ranks(path)
        self.path = path
        self.share = share
        self.pattern = regex.compile(pattern)
        self.long_piece = long_piece
        self.young: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, bytes] = {}  # packed
        self.byte_ids = np.array([of[bytes([i])] for i in range(256)], np.int32)
        merges = [
            (of[t[:i]] * 65536 + of[t[i:]], rank)
            for t, rank in of.items()
            for i in range(1, len(t))
            if t[:i] in of and t[i:] in of
        ]
        pairs = pa.table({"pair": pa.array([m[0] for m in merges], pa.int64()), "rank": pa.array([m[1] for m in merges], pa.int32())})
        tokens = pa.table({"tok": pa.array(list(of.values()), pa.int32()), "hex": [t.hex() for t in of]})
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": os.path.join(tempfile.gettempdir(), f"bpe-{os.getpid()}")})
        for name, rows in (("merges", pairs), ("vocab", tokens)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def _contract(self, pieces: list[bytes], long: bool) -> list[tuple[int, str, str]]:
        size = np.array([len(p) for p in pieces])
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        pos = (np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        start = pa.table({"piece": piece, "pos": pos, "tok": self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]})
        one_round = _EVERY_SEPARATE if long and _proved(self.path) else _LEFTMOST
        rows, into = start.num_rows, "even"
        self.db.register("start", start)
        try:
            came = "start"
            while True:
                rounds = max(1, SLICE_ROWS // self.share // rows)
                self.db.execute(_SLICE.format(into=into, start=came, round=one_round.format(rounds=rounds)))
                rows, most = self.db.execute(f"SELECT count(*), max(round) FROM {into}").fetchone()
                if most < rounds:
                    return self.db.execute(_RESULT.format(parts=into)).fetchall()
                came, into = into, "odd" if into == "even" else "even"
        finally:
            self.db.unregister("start")

    def learn(self, pieces: list[str]) -> None:
        """Encode and decode these pieces and keep the result."""
        raw = [p.encode() for p in pieces]
        most_pieces, most_bytes = max(1, NEW_PIECES // self.share), PIECE_BYTES // self.share
        for long in (False, True):
            own = [i for i, r in enumerate(raw) if (len(r) > self.long_piece) == long]
            edges = np.cumsum([len(raw[i]) for i in own])
            a = 0
            while a < len(own):  # at most so many pieces of so many bytes, one at least
                z = int(np.searchsorted(edges, most_bytes + (edges[a - 1] if a else 0), "right"))
                step = own[a : max(a + 1, min(z, a + most_pieces))]
                for n, ids, decoded in self._contract([raw[i] for i in step], long):
                    self.young[pieces[step[n]]] = (ids, bytes.fromhex(decoded))
                a += len(step)

    def encode(self, texts: list[str]) -> list[tuple[list[str], list[bytes]]]:
        """For each text, the ids of each piece (joined by commas) and its decoded bytes."""
        cut = [self.pattern.findall(t) for t in texts]
        young, old = self.young, self.old
        new = set()
        for pieces in cut:
            for p in set(pieces):
                if p not in young:
                    hit = old.get(p)
                    if hit is None:
                        new.add(p)
                    else:
                        young[p] = _unpacked(hit)
        if new:
            self.learn(sorted(new))
        out = []
        for pieces in cut:
            got = [young[p] for p in pieces]
            out.append(([g[0] for g in got], [g[1] for g in got]))
        if len(young) > CACHE_PIECES // self.share:
            self.old, self.young = {}, {}
            while young:  # one at a time, so the two forms are never held together
                p, hit = young.popitem()
                self.old[p] = _packed(hit)
        return out


@functools.lru_cache(maxsize=1)
def _codec(path: str, pattern: str, share: int = 1) -> Codec:
    return Codec(path, pattern, share=share)


def _digests(path: str, pattern: str, share: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern, share)
        for b in batches:
            n, ids_sha, decoded_sha = [], [], []
            texts: list[str] = []

            def flush() -> None:
                for ids, decoded in codec.encode(texts):
                    joined = ",".join(ids)
                    n.append(joined.count(",") + 1 if joined else 0)
                    ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(b"".join(decoded)).hexdigest())
                texts.clear()

            held, column = 0, b.column("text")
            for i in range(b.num_rows):
                texts.append(column[i].as_py() or "")
                held += len(texts[-1])
                if held >= BATCH_CHARS // share:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _ids(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for b in batches:
            column = b.column("text")
            ids = [[int(x) for x in ",".join(codec.encode([column[i].as_py() or ""])[0][0]).split(",") if x] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids) per row of ``docs``; ``path`` names a rank file the executors can read."""
    d = docs.select(docs.doc_id.cast("long").alias("doc_id"), "text")
    return d.mapInArrow(_ids(path, pattern), "doc_id long, ids array<int>")


def token_digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, share: int = 1) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row of ``docs``; ``share`` makes a worker's cache, batches and slices smaller."""
    d = docs.select(docs.doc_id.cast("long").alias("doc_id"), "text")
    return d.mapInArrow(_digests(path, pattern, share), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_recursive_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


QUERIES = {"op7_recursive_bpe": op7_recursive_bpe}
ORACLES: dict[str, str] = {}
