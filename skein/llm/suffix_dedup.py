"""Suffix-array deduplication: hash-compared suffix sort.

Every byte covered by a ``SPAN``-byte string that also starts in a document with a
smaller doc_id is removed; texts are UTF-8 bytes and are judged as given.

Prefix polynomial hashes (mod 2**64) give any substring's hash by two look-ups.

1. *Anchors.*  Each 50-byte window has an anchor: the start of its 20-byte
   substring with the least hash (the leftmost of equals), a choice that depends
   on the window's bytes alone.  Consecutive windows with one anchor form a
   segment.  A segment is known by its anchor's hash and its own hash, about one
   for 16 bytes of text.  Within an Arrow batch a segment that equals one of a
   smaller document byte for byte is settled on the spot; the covered bytes go
   to the answer as runs.  One document of the batch stands for each other segment.
2. *Meeting.*  These travel, packed, to the anchor's bucket.  An anchor that
   several documents have is worth a look; its segments are asked for their bytes.
3. *Suffix sort.*  Segments with equal hashes are compared byte by byte: those of
   larger documents are covered.  Of each that stays, all suffixes that start at
   its windows are mergesorted with those of the anchor's other segments.  Two
   suffixes are compared by a binary search with prefix hashes for their common
   extension, so a comparison takes log2(50) steps, and the byte after it decides.
   Runs of suffixes with a common extension of 50 bytes are verified byte by byte
   before the smallest doc_id of a run counts.
4. The windows found return to their documents, which mark the covered bytes.

Nothing is covered by a hash alone.  An anchor with more than ``HOT_ENTRIES``
segments is split: holders of one segment are dealt in parts of so many, the
smallest holder goes to each of them, and the windows of its different segments
are dealt by their own hash (there alone a collision of two 48-bit hashes would
hide a match).  What a third of all documents share reaches its
bucket once per batch, 18 bytes each; a bucket holds about ``BUCKET_ENTRIES``
segments however large the input is, suffixes are sorted ``SORT_ROWS`` at a time, and
long texts are worked on in chunks.

Texts move only for documents with codes: a bitmap sized by their number filters
before the shuffle (``MOST_BITS`` bounds it; where documents are so many that it
would let most pass there is none and all texts move).

Defined results: a null text is empty and loses nothing; texts under 50 bytes
lose nothing; equal doc_ids do not cover each other, whatever their texts; a null
doc_id counts as larger than any other; of documents that tie for a string the
smallest doc_id keeps it; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.columns import documents
from skein.plans.storage import table

SPAN = 50
GRAM = 20
WIDTH = SPAN - GRAM + 1
CHUNK = 1 << 18
BATCH_BYTES = 10_000_000
BUCKET_ENTRIES = 500_000
SORT_ROWS = 200_000
DENSITY = 2 / (WIDTH + 1)
HOT_ENTRIES = 20_000
MOST_BITS = 1 << 27
NO_ID = (1 << 63) - 1

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 22) - 1)
#: Rows that meet at a document: covered runs, windows found, places of equal segments, wanted bytes, the text.
_RUN, _WINDOWS, _SAME, _ASK, _TEXT = 0, 1, 2, 3, 4
_BLOB = 9
_ROOM = SPAN + WIDTH - 1
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE), dtype=np.uint64)])
        _inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE_INVERSE), dtype=np.uint64)])
    return _powers, _inverses


def prefix_hashes(b: np.ndarray) -> np.ndarray:
    """``h[i]``: the hash of the first ``i`` bytes."""
    powers, _ = _power_tables(len(b) + 1)
    h = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers[: len(b)], out=h[1:])
    return h


def substring_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ``[start, end)``, equal for equal bytes wherever they stand."""
    _, inverses = _power_tables(len(h))
    return (h[end] - h[start]) * inverses[start]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _SPREAD
    x = (x ^ (x >> np.uint64(32))) * _SPREAD
    return x ^ (x >> np.uint64(32))


def segments(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, anchor hash, segment id) of each segment."""
    parts = []
    every = np.frombuffer(raw, np.uint8)
    for c in range(0, len(every) - SPAN + 1, CHUNK):
        b = every[c : c + CHUNK + SPAN - 1]
        n = len(b)
        h = prefix_hashes(b)
        _, inverses = _power_tables(n + 1)
        grams = (h[GRAM:] - h[: n - GRAM + 1]) * inverses[: n - GRAM + 1]
        grams = (grams ^ (grams >> np.uint64(32))) * _SPREAD  # the upper bits, which alone are used, depend on all
        least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        have = 1
        while 2 * have <= WIDTH:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < WIDTH:
            least = np.minimum(least[: len(least) - (WIDTH - have)], least[WIDTH - have :])
        at = (least & _LOW).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1])
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        anchor = at[first]
        shape = ((anchor - first) * 64 + (last - first)).astype(np.uint64)
        own = _mix(substring_hashes(h, first, last + SPAN) + _mix(shape + np.uint64(1)))
        parts.append((first + c, last + c, anchor + c, grams[anchor], own))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _pack(x: np.ndarray) -> bytes:
    """The upper six bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1).astype(np.uint64)


_CUT = ~np.uint64(0xFFFF)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(order, key, bytes) lists of about ``BATCH_BYTES``."""
    order, keys, raws, held = [], [], [], 0
    for b in batches:
        o, k, t = b.column("order").to_pylist(), b.column("key").to_pylist(), b.column("raw")
        for i in range(b.num_rows):
            raw = t[i].as_py()
            order.append(o[i])
            keys.append(k[i])
            raws.append(raw)
            held += len(raw)
            if held >= BATCH_BYTES:
                yield order, keys, raws
                order, keys, raws, held = [], [], [], 0
    if order:
        yield order, keys, raws


def _laid_out(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, each followed by room for a segment, and where they begin."""
    gap = bytes(_ROOM)
    base = np.concatenate([[0], np.cumsum([len(r) + _ROOM for r in raws])])[:-1].astype(np.int64)
    return np.frombuffer(b"".join(x for r in raws for x in (r, gap)), np.uint8), base


def _same_bytes(buffer: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the ``n`` windows from ``x`` hold the bytes of those from ``y``."""
    out = np.zeros(len(x), bool)
    if not len(x):
        return out
    rows = np.lib.stride_tricks.sliding_window_view(buffer, _ROOM)
    beyond = np.arange(_ROOM) >= np.arange(WIDTH + 1)[:, None] + SPAN - 1
    for a in range(0, len(x), 50_000):
        part = slice(a, a + 50_000)
        out[part] = ((rows[x[part]] == rows[y[part]]) | beyond[n[part]]).all(axis=1)
    return out


def _runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that intervals cover."""
    by = np.argsort(start, kind="stable")
    start, reach = start[by], np.maximum.accumulate(end[by])
    first = np.nonzero(np.concatenate([[True], start[1:] > reach[:-1]]))[0]
    return start[first], reach[np.append(first[1:], len(start)) - 1]


_BLOB_FIELDS = ("docs", "keys", "a", "e", "o", "pos", "shape")
_CODE_SCHEMA = "home int, kind int, payload binary"


def _arrow(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values())], list(types))


_CODE_TYPES = {"home": pa.int32(), "kind": pa.int32(), "payload": pa.binary()}
_MEETING_TYPES = {"bucket": pa.int32(), **_CODE_TYPES, **{f: pa.binary() for f in _BLOB_FIELDS}}
_CONTEXT_FIELDS = ("docs", "keys", "o", "pos", "shape", "shift", "g", "e", "bytes")
_CONTEXT_TYPES = {"bucket": pa.int32(), **{f: pa.binary() for f in _CONTEXT_FIELDS}}
_RECORDS = {
    _RUN: np.dtype([("doc", "<i8"), ("key", "<i8"), ("x", "<u4"), ("y", "<u4")]),
    _ASK: np.dtype([("doc", "<i8"), ("key", "<i8"), ("pos", "<u4"), ("shape", "<u2"), ("g", "u1", 6), ("e", "<u4")]),
}
_RECORDS[_SAME] = _RECORDS[_WINDOWS] = _RECORDS[_RUN]


def _code_rows(homes: int, kind: int, doc: np.ndarray, key: np.ndarray, *fields: np.ndarray) -> pa.RecordBatch:
    """Records of (doc, key, fields), a row for each home: texts of one home meet their records in one place."""
    home = (doc ^ key) % homes
    by = np.lexsort((key, doc, home))
    home = home[by]
    records = np.empty(len(by), _RECORDS[kind])
    for name, values in zip(records.dtype.names, (doc, key, *fields)):
        records[name] = values[by]
    first = np.nonzero(np.concatenate([[True], home[1:] != home[:-1]]))[0] if len(by) else by
    offsets = (np.append(first, len(by)) * records.itemsize).astype(np.int32)
    payload = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(records.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(home[first].astype(np.int32)), pa.array(np.full(len(first), kind, np.int32)), payload], list(_CODE_TYPES))


def _six(x: np.ndarray) -> np.ndarray:
    """The upper six bytes of each number, as rows."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, 2:]


def _places(local: np.ndarray, n: int) -> bytes:
    """Places in a list of ``n`` texts, in two bytes each where they fit."""
    return local.astype("<u2" if n <= 1 << 16 else "<u4").tobytes()


def _listed(row: dict, name: str) -> np.ndarray:
    """The entries' values of a list with a row per text."""
    n = len(row["pos"]) // 4
    return np.frombuffer(row[name], np.int64)[np.frombuffer(row["o"], "<u2" if len(row["o"]) == 2 * n else "<u4")]


def _chunks(rows: Iterator[tuple], types: dict[str, pa.DataType], most: int) -> Iterator[pa.RecordBatch]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == most:
            yield _arrow(part, types)
            part = []
    if part:
        yield _arrow(part, types)


def _passing(codes: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """Code rows that only pass through a bucket, any one."""
    bucket = pa.array(codes.column("home").to_numpy() % np.int32(buckets))
    nothing = [pa.nulls(codes.num_rows, pa.binary())] * len(_BLOB_FIELDS)
    return pa.RecordBatch.from_arrays([bucket, *codes.columns, *nothing], list(_MEETING_TYPES))


def _batch_entries(order: list[int], keys: list[int], raws: list[bytes], buckets: int) -> Iterator[pa.RecordBatch]:
    """What a batch settles itself, as runs, and its other segments by bucket."""
    docs, keys = np.array(order, np.int64), np.array(keys, np.int64)
    rank = np.lexsort((keys, docs))
    docs, keys = docs[rank], keys[rank]
    buffer, base = _laid_out([raws[i] for i in rank])
    cols, same = [], []
    total = 0
    for k, i in enumerate(rank):
        first, last, at, anchor, own = segments(raws[i])
        own = own & _CUT
        _, once, back = np.unique(own, return_index=True, return_inverse=True)
        lead = once[back]
        n = last - first + 1
        other = np.nonzero(lead != np.arange(len(own)))[0]
        if len(other):  # the segment again in the same text, if its bytes are the same too
            fine = (n[other] == n[lead[other]]) & ((at - first)[other] == (at - first)[lead[other]])
            fine &= _same_bytes(buffer, base[k] + first[other], base[k] + first[lead[other]], n[other])
            lead[other[~fine]] = other[~fine]
        stays = np.nonzero(lead == np.arange(len(own)))[0]
        place = np.zeros(len(own), np.int64)
        place[stays] = total + np.arange(len(stays))
        repeat = np.nonzero(lead != np.arange(len(own)))[0]
        same.append((place[lead[repeat]], first[repeat]))
        cols.append((anchor[stays] & _CUT, own[stays], np.full(len(stays), k, np.int32), first[stays], n[stays], (at - first)[stays]))
        total += len(stays)
    a, e, o, pos, n, off = (np.concatenate(x) for x in zip(*cols))
    entry, again = (np.concatenate(x) for x in zip(*same))
    by = np.lexsort((o, e, a))
    new = np.ones(total, bool)
    x, y = by[1:], by[:-1]
    new[1:] = (a[x] != a[y]) | (e[x] != e[y])
    lead = np.zeros(total, np.int64)
    lead[by] = by[np.nonzero(new)[0]][np.cumsum(new) - 1] if total else by
    settled = docs[o] > docs[o[lead]] if total else np.zeros(0, bool)
    settled &= (n == n[lead]) & (off == off[lead])
    at = np.nonzero(settled)[0]
    start = base[o] + pos
    settled[at] = _same_bytes(buffer, start[at], start[lead[at]], n[at])
    # Covered runs of each text, all places of a settled segment included.
    hit = settled[entry]
    s = np.concatenate([start[settled], base[o[entry[hit]]] + again[hit]])
    if len(s):
        z = s + np.concatenate([n[settled], n[entry[hit]]]) + SPAN - 1
        s, z = _runs(s, z)
        k = np.searchsorted(base, s, "right") - 1
        yield _passing(_code_rows(buckets, _RUN, docs[k], keys[k], s - base[k], z - base[k]), buckets)
    entry, again = entry[~hit], again[~hit]
    if len(entry):
        yield _passing(_code_rows(buckets, _SAME, docs[o[entry]], keys[o[entry]], pos[entry], again), buckets)
    left = by[~settled[by]]
    bucket = ((a[left] >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)
    spread = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[spread], np.arange(buckets + 1))
    rows = []
    for k in np.nonzero(np.diff(edges))[0]:
        at = left[spread[edges[k] : edges[k + 1]]]
        named, local = np.unique(o[at], return_inverse=True)
        rows.append((
            int(k), None, _BLOB, None, docs[named].tobytes(), keys[named].tobytes(), _pack(a[at]), (e[at] >> np.uint64(32)).astype("<u4").tobytes(),
            _places(local, len(named)), pos[at].astype("<u4").tobytes(), (n[at] * 64 + off[at]).astype("<u2").tobytes(),
        ))
    for a in range(0, len(rows), 64):
        yield _arrow(rows[a : a + 64], _MEETING_TYPES)


def _meeting(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for order, keys, raws in _texts(batches):
            yield from _batch_entries(order, keys, raws, buckets)

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """All rows of each bucket; the input is sorted by bucket."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and row["bucket"] != held[0]["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _asks(rows: list[dict], homes: int) -> Iterator[pa.RecordBatch]:
    """For the bytes of every segment whose anchor several documents of the bucket have."""
    doc, key = (np.concatenate([_listed(r, f) for r in rows]) for f in ("docs", "keys"))
    a, e = np.concatenate([_unpack(r["a"]) for r in rows]), np.concatenate([np.frombuffer(r["e"], "<u4") for r in rows])
    pos, shape = (np.concatenate([np.frombuffer(r[f], t) for r in rows]) for f, t in (("pos", "<u4"), ("shape", "<u2")))
    by = np.lexsort((doc, e, a))
    doc, key, a, e, pos, shape = (x[by] for x in (doc, key, a, e, pos, shape))
    head = np.nonzero(np.concatenate([[True], a[1:] != a[:-1]]))[0]
    size = np.diff(np.append(head, len(a)))
    several = np.repeat(np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head), size)
    hot = np.repeat(size > HOT_ENTRIES, size)

    def ask(at: np.ndarray, group: np.ndarray, windows: int) -> pa.RecordBatch:
        return _code_rows(homes, _ASK, doc[at], key[at], pos[at], shape[at] + np.uint16(windows * 4096), _six(group), e[at])

    plain = np.nonzero(several & ~hot)[0]
    yield ask(plain, a[plain], 0)
    wide = np.nonzero(several & hot)[0]
    if not len(wide):
        return
    # The holders of one segment of a hot anchor in parts, its smallest holder in each of them.
    new = np.concatenate([[True], (a[wide][1:] != a[wide][:-1]) | (e[wide][1:] != e[wide][:-1])])
    lead = wide[np.nonzero(new)[0]][np.cumsum(new) - 1]
    first = np.nonzero(new)[0]
    nth = np.arange(len(wide)) - first[np.cumsum(new) - 1]
    part = nth // HOT_ENTRIES
    group = _mix(_mix(a[wide] ^ _mix(e[wide].astype(np.uint64))) + part.astype(np.uint64)) & _CUT
    holders = np.diff(np.append(first, len(wide)))[np.cumsum(new) - 1]
    held = holders > 1
    yield ask(wide[held], group[held], 0)
    more = np.nonzero(held & (part > 0) & (nth % HOT_ENTRIES == 0))[0]
    yield ask(lead[more], group[more], 0)
    # The windows of its different segments by their own hash.
    tops = wide[doc[wide] == doc[lead]]
    yield ask(tops, a[tops], 1)


def _match_segments(homes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.RecordBatch] = []

        def blobs() -> Iterator[pa.RecordBatch]:
            for b in batches:
                blob = pa.compute.equal(b.column("kind"), _BLOB)
                codes = b.filter(pa.compute.invert(blob)).select(list(_CODE_TYPES))
                if codes.num_rows:
                    ready.append(codes)
                yield b.filter(blob)

        for rows in _by_bucket(blobs()):
            yield from ready
            ready.clear()
            yield from _asks(rows, homes)
        yield from ready

    return run


_NOTHING: dict[int, np.ndarray] = {}


def _with_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, dict[int, np.ndarray]]]:
    """Each text with its records by kind; the input is sorted by (home, kind), texts last."""
    now, payloads, of = None, {}, None
    for b in batches:
        home, kind = b.column("home").to_pylist(), b.column("kind").to_pylist()
        order, key, payload = b.column("order").to_pylist(), b.column("key").to_pylist(), b.column("payload")
        for i in range(b.num_rows):
            if home[i] != now:
                now, payloads, of = home[i], {}, None
            if kind[i] != _TEXT:
                payloads.setdefault(kind[i], []).append(payload[i].as_py())
                continue
            if of is None:  # all records of the home are here
                of = {}
                for k, parts in payloads.items():
                    records = np.frombuffer(b"".join(parts), _RECORDS[k])
                    by = np.lexsort((records["key"], records["doc"]))
                    records = records[by]
                    doc, own = records["doc"], records["key"]
                    edges = np.concatenate([[0], np.nonzero((doc[1:] != doc[:-1]) | (own[1:] != own[:-1]))[0] + 1, [len(records)]])
                    for s, t in zip(edges[:-1].tolist(), edges[1:].tolist()):
                        of.setdefault((int(doc[s]), int(own[s])), {})[k] = records[s:t]
                payloads = {}
            yield order[i], key[i], payload[i].as_py(), of.get((order[i], key[i]), _NOTHING)


def _context_rows(held: list[tuple[int, int, bytes, np.ndarray]], buckets: int) -> Iterator[tuple]:
    docs, keys = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
    buffer, base = _laid_out([h[2] for h in held])
    asked = np.concatenate([h[3] for h in held])
    o = np.repeat(np.arange(len(held)), [len(h[3]) for h in held])
    pos, shape = asked["pos"].astype(np.int64), asked["shape"].astype(np.int64)
    g, e = _unpack(asked["g"].tobytes()), asked["e"].astype(np.uint64)
    windows, n, off, shift = shape >= 4096, shape % 4096 // 64, shape % 64, np.zeros(len(o), np.int64)
    target = g
    if windows.any():
        w = np.nonzero(windows)[0]
        each = np.repeat(w, n[w])
        step = np.arange(len(each)) - np.repeat(np.cumsum(n[w]) - n[w], n[w])
        h = prefix_hashes(buffer)
        start = base[o[each]] + pos[each] + step
        own = _mix(substring_hashes(h, start, start + SPAN)) >> np.uint64(32)
        group = _mix(g[each] + (step - off[each] + WIDTH).astype(np.uint64)) & _CUT
        plain = np.nonzero(~windows)[0]
        both = np.concatenate([plain, each])
        one = np.ones(len(each), np.int64)
        target = np.concatenate([g[plain], _mix(group ^ _mix(own)) & _CUT])
        g, e = np.concatenate([g[plain], group]), np.concatenate([e[plain], own])
        n, off, shift = np.concatenate([n[plain], one]), np.concatenate([off[plain], 0 * one]), np.concatenate([shift[plain], step])
        o, pos = o[both], pos[both]
    bucket = ((target >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for k in np.nonzero(np.diff(edges))[0]:
        at = by[edges[k] : edges[k + 1]]
        named, local = np.unique(o[at], return_inverse=True)
        size = n[at] + SPAN - 1
        start = base[o[at]] + pos[at] + shift[at]
        every = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        yield (
            int(k), docs[named].tobytes(), keys[named].tobytes(), _places(local, len(named)), pos[at].astype("<u4").tobytes(),
            (n[at] * 64 + off[at]).astype("<u2").tobytes(), shift[at].astype(np.uint8).tobytes(), _pack(g[at]), e[at].astype("<u4").tobytes(), pa.compress(buffer[every].tobytes(), codec="zstd", asbytes=True),
        )


def _contexts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for order, key, raw, codes in _with_codes(batches):
            asks = codes.get(_ASK)
            if asks is not None:
                held.append((order, key, raw, asks))
                size += len(raw)
            if size > BATCH_BYTES // 2:
                yield from _chunks(_context_rows(held, buckets), _CONTEXT_TYPES, 16)
                held, size = [], 0
        if held:
            yield from _chunks(_context_rows(held, buckets), _CONTEXT_TYPES, 16)

    return run


class SuffixSort:
    """Mergesort of suffixes inside groups, comparing by common extension.

    ``local`` numbers the bytes of each stretch that suffixes do not leave; powers go by it.
    """

    def __init__(self, buffer: np.ndarray, span: int = SPAN, local: np.ndarray | None = None):
        self.b, self.span = buffer, span
        self.local = np.arange(len(buffer)) if local is None else local
        powers, self.inverses = _power_tables(int(self.local.max()) + 1 if len(buffer) else 1)
        self.h = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers[self.local], out=self.h[1:])

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes, ``span`` at most, by binary search on hashes."""
        h = self.h
        hx, hy, ix, iy = h[x], h[y], self.inverses[self.local[x]], self.inverses[self.local[y]]
        got = np.zeros(len(x), np.int64)
        step = 1 << (self.span.bit_length() - 1)
        while step:
            longer = got + step
            at = np.minimum(longer, self.span)
            same = (h[x + at] - hx) * ix == (h[y + at] - hy) * iy
            got = np.where(same & (longer <= self.span), longer, got)
            step >>= 1
        return got

    def before(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        ext = self.extension(x, y)
        whole = ext >= self.span
        at = np.where(whole, 0, ext)
        return np.where(whole, or_equal, self.b[x + at] < self.b[y + at])

    def order(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """A permutation that sorts ``start`` by suffix inside each run of equal ``group``."""
        perm = np.arange(len(start))
        head = np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0]
        size = np.diff(np.append(head, len(start)))
        base, count = np.repeat(head, size), np.repeat(size, size)
        local = np.arange(len(start)) - base
        run = 1
        while run < (size.max() if len(size) else 0):
            live = np.nonzero(count > run)[0]
            block = local[live] // (2 * run) * (2 * run)
            right = local[live] - block >= run
            lo = np.where(right, block, np.minimum(block + run, count[live]))
            hi = np.where(right, block + run, np.minimum(block + 2 * run, count[live]))
            low, high = lo.copy(), hi.copy()
            while True:
                open_ = np.nonzero(low < high)[0]
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                theirs = start[perm[base[live[open_]] + mid]]
                mine = start[perm[live[open_]]]
                less = self.before(theirs, mine, right[open_])
                low[open_] = np.where(less, mid + 1, low[open_])
                high[open_] = np.where(less, high[open_], mid)
            place = base[live] + block + (local[live] - block - np.where(right, run, 0)) + (low - lo)
            moved = perm.copy()
            moved[place] = perm[live]
            perm = moved
            run *= 2
        return perm

    def classes(self, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(permutation, class of each place): equal classes hold equal strings of ``span`` bytes."""
        perm = self.order(start, group)
        s = start[perm]
        same = np.zeros(len(s), bool)
        same[1:] = (group[1:] == group[:-1]) & (self.extension(s[:-1], s[1:]) >= self.span)
        wide = np.arange(self.span)
        for k in range(0, len(s), 20_000):  # equal hashes are no proof: compare the bytes
            at = k + np.nonzero(same[k : k + 20_000])[0]
            if len(at):
                same[at] = (self.b[s[at, None] + wide] == self.b[s[at - 1, None] + wide]).all(axis=1)
        return perm, np.cumsum(~same) - 1


def _windows_found(rows: list[dict], homes: int) -> pa.RecordBatch:
    """The windows of a bucket's segments that a smaller document has."""
    doc, key = (np.concatenate([_listed(r, f) for r in rows]) for f in ("docs", "keys"))
    g, e = np.concatenate([_unpack(r["g"]) for r in rows]), np.concatenate([np.frombuffer(r["e"], "<u4") for r in rows])
    pos, shape, shift = (np.concatenate([np.frombuffer(r[f], t) for r in rows]).astype(np.int64) for f, t in (("pos", "<u4"), ("shape", "<u2"), ("shift", "u1")))
    n, off = shape // 64, shape % 64
    inflated = [pa.decompress(r["bytes"], int((np.frombuffer(r["shape"], "<u2") // 64 + SPAN - 1).sum(dtype=np.int64)), codec="zstd", asbytes=True) for r in rows]
    buffer = np.frombuffer(b"".join([*inflated, bytes(_ROOM)]), np.uint8)
    del inflated
    base = np.cumsum(n + SPAN - 1) - n - SPAN + 1
    by = np.lexsort((doc, shape, e, g))
    doc, key, g, e, pos, shape, shift, n, off, base = (x[by] for x in (doc, key, g, e, pos, shape, shift, n, off, base))
    # Equal segments: the hashes only say which to compare.
    same = np.zeros(len(g), bool)
    same[1:] = (g[1:] == g[:-1]) & (e[1:] == e[:-1]) & (shape[1:] == shape[:-1])
    at = np.nonzero(same)[0]
    same[at] = _same_bytes(buffer, base[at], base[at - 1], n[at])
    head = np.nonzero(~same)[0]
    lead = head[np.cumsum(~same) - 1]
    mask = np.where(doc > doc[lead], (np.int64(1) << n) - 1, 0)
    # Of each different segment of an anchor the windows of its smallest holder are sorted.
    _, number, size = np.unique(g[head], return_inverse=True, return_counts=True)
    some = size[number] > 1
    tops, number = head[some], number[some]
    held = np.repeat(np.arange(len(tops)), n[tops])
    window = np.arange(len(held)) - np.repeat(np.cumsum(n[tops]) - n[tops], n[tops])
    group = number[held] * 64 + (window - off[tops][held] + WIDTH)  # equal windows of one anchor stand at one distance from it
    order = np.lexsort((doc[tops][held], group))
    held, window, group = held[order], window[order], group[order]
    _, back, size = np.unique(group, return_inverse=True, return_counts=True)
    met = size[back] > 1
    held, window, group = held[met], window[met], group[met]
    if len(held):
        size = n[tops] + SPAN - 1
        start = np.cumsum(size) - size
        local = (np.arange(size.sum()) - np.repeat(start, size)).astype(np.int16)
        sort, owner = SuffixSort(buffer[np.repeat(base[tops], size) + local], local=local), doc[tops]
        found = np.zeros(len(tops), np.int64)
        heads = np.append(np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0], len(group))
        a = 0
        while a < len(group):  # whole groups, about SORT_ROWS suffixes at a time
            z = int(heads[max(np.searchsorted(heads, a + SORT_ROWS, "right") - 1, np.searchsorted(heads, a, "right"))])
            h, w, k = held[a:z], window[a:z], group[a:z]
            perm, cls = sort.classes(start[h] + w, k)
            least = np.full(cls[-1] + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, cls, owner[h[perm]])
            covered = perm[owner[h[perm]] > least[cls]]
            np.bitwise_or.at(found, h[covered], np.int64(1) << w[covered])
            a = z
        of = np.full(len(g), -1)
        of[tops] = np.arange(len(tops))
        twin = np.nonzero((doc == doc[lead]) & (of[lead] >= 0))[0]  # the same segment in texts of one doc_id
        mask[twin] |= found[of[lead[twin]]]
    hit = np.nonzero(mask)[0]
    return _code_rows(homes, _WINDOWS, doc[hit], key[hit], pos[hit], mask[hit] << shift[hit])


def _sort_suffixes(homes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            yield _windows_found(rows, homes)

    return run


def covered_bytes(size: int, codes: dict[int, np.ndarray]) -> np.ndarray:
    """Which bytes of a text its records cover."""
    edge = np.zeros(size + 1, np.int32)

    def numbers(kind: int) -> tuple[np.ndarray, np.ndarray]:
        own = codes.get(kind)
        return (np.zeros(0, np.int64),) * 2 if own is None else (own["x"].astype(np.int64), own["y"].astype(np.int64))

    start, end = numbers(_RUN)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    pos, mask = numbers(_WINDOWS)
    if len(pos):
        first, again = numbers(_SAME)
        if len(first):  # what holds for a segment holds for its other places
            by = np.argsort(first, kind="stable")
            first, again = first[by], again[by]
            low, high = np.searchsorted(first, pos, "left"), np.searchsorted(first, pos, "right")
            k = np.repeat(np.arange(len(pos)), high - low)
            at = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(len(k))
            pos, mask = np.concatenate([pos, again[at]]), np.concatenate([mask, mask[k]])
        i, w = np.nonzero(mask[:, None] >> np.arange(WIDTH) & 1)
        np.add.at(edge, pos[i] + w, 1)
        np.add.at(edge, pos[i] + w + SPAN, -1)
    return np.cumsum(edge[:-1]) > 0


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []

    def out() -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), *[pa.array(c, pa.int64()) for c in cols[1:4]], pa.array(cols[4], pa.string())],
            ["order", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    for o, _, raw, codes in _with_codes(batches):
        gone = covered_bytes(len(raw), codes)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        rows.append((o, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        if len(rows) == 5000:
            yield out()
            rows.clear()
    if rows:
        yield out()


_CHUNK_BYTES = 4096


def _bits(size: int):
    """The documents of a task's records as a bitmap, in chunks that are not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(max(size // 8, _CHUNK_BYTES), np.uint8)
        for b in batches:
            kind, payload = b.column("kind").to_pylist(), b.column("payload")
            for i in range(b.num_rows):
                doc = np.frombuffer(payload[i].as_py(), _RECORDS[kind[i]])["doc"].astype(np.int64)
                at = (doc ^ (doc.view(np.uint64) >> np.uint64(21)).view(np.int64)) % size
                np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        rows = bits.reshape(-1, _CHUNK_BYTES)
        some = np.nonzero(rows.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[k].tobytes() for k in some], pa.binary())], ["k", "bits"])

    return run


def _with(codes: DataFrame, documents: int) -> Column | None:
    """Whether a row's ``order`` may be one of ``codes``; None if there are too many documents for a bitmap to tell."""
    size = 1 << max(16, (8 * documents).bit_length())
    if size > MOST_BITS:
        return None
    parts = codes.select("kind", "payload").mapInArrow(_bits(size), "k int, bits binary").groupBy("k").agg(F.bitmap_or_agg("bits").alias("bits"))
    bits = np.zeros((max(size // 8, _CHUNK_BYTES) // _CHUNK_BYTES, _CHUNK_BYTES), np.uint8)
    for r in parts.collect():  # at most MOST_BITS / 8 bytes
        bits[r.k] = np.frombuffer(bytes(r.bits), np.uint8)
    flat = bits.reshape(-1)

    @F.pandas_udf("boolean")
    def run(position):
        p = position.to_numpy()
        return pd.Series((flat[p >> 3] >> (p & 7)) & 1 == 1)

    order = F.col("order")
    return run(F.pmod(order.bitwiseXOR(F.shiftrightunsigned(order, 21)), F.lit(size)))


def _release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results have been written.

    It does so when the driver's collector finds their plans, which the listeners let go of a moment after the job.
    """
    for _ in range(3):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs``."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("order"), raw.alias("raw")).withColumn("key", F.xxhash64("raw"))
    total, documents = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, math.ceil(total * DENSITY / BUCKET_ENTRIES))

    blobs = lambda fields: ", ".join(f"{f} binary" for f in fields)
    entries = base.where(F.octet_length("raw") >= SPAN).mapInArrow(_meeting(buckets), f"bucket int, {_CODE_SCHEMA}, {blobs(_BLOB_FIELDS)}")
    matched = table(entries.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_match_segments(buckets), _CODE_SCHEMA), "segments")

    _release(docs.sparkSession)

    def meet(codes: DataFrame, hit: Column | None) -> DataFrame:
        own = base if hit is None else base.where(hit)
        home = F.pmod(F.col("order").bitwiseXOR(F.col("key")), F.lit(buckets)).cast("int")
        texts = own.select(home.alias("home"), F.lit(_TEXT).alias("kind"), "order", "key", F.col("raw").alias("payload"))
        none = F.lit(None).cast("long")
        return codes.select("home", "kind", none.alias("order"), none.alias("key"), "payload").unionAll(texts).repartition(buckets, "home").sortWithinPartitions("home", "kind")

    asks = matched.where(F.col("kind") == _ASK)
    contexts = meet(asks, _with(asks, documents)).mapInArrow(_contexts(buckets), f"bucket int, {blobs(_CONTEXT_FIELDS)}")
    found = table(contexts.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_sort_suffixes(buckets), _CODE_SCHEMA), "windows")

    _release(docs.sparkSession)

    runs = matched.where(F.col("kind") == _RUN)
    answers = runs.unionAll(found)
    hit = _with(answers, documents)
    places = matched.where(F.col("kind") == _SAME)
    some = meet(answers.unionAll(places), hit).mapInArrow(_finish, "order long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if hit is not None:
        none = base.where(~hit).select(
            "order", F.octet_length("raw").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("raw", 256).alias("kept_sha256")
        )
        some = some.unionAll(none)
    return some.select(F.when(F.col("order") != NO_ID, F.col("order")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


QUERIES = {"op4_suffix_sort": op4_suffix_sort}
ORACLES = {
    "op4_suffix_sort": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
 m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s),
 c AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w JOIN m USING (s) WHERE low < doc_id),
 g AS (SELECT doc_id, p, sum((before IS NULL OR p > before + 50)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c),
 r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, run),
 k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM r),
 f AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS head FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN f USING (doc_id)""",
}
