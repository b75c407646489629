import hashlib
import random
from collections import Counter

import numpy as np
from data import SCHEMA, awkward_rows, frame
from skein.llm import suffix_dedup as s


def brute(rows):
    first = {}
    raws = [(r[0], (r[1] or "").encode()) for r in rows]
    for i, raw in raws:
        key = s.NO_ID if i is None else i
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            first[w] = min(first.get(w, key), key)
    out = Counter()
    for i, raw in raws:
        key = s.NO_ID if i is None else i
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < key:
                gone[p : p + 50] = True
        spans = sum(gone[p] and (p == 0 or not gone[p - 1]) for p in range(len(raw)))
        out[i, len(raw), int(gone.sum()), int(spans), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


def planted(seed):
    rnd = random.Random(seed)
    words = [a + b for a in ("ta", "re", "mo", "é") for b in ("n", "ck", "st", "")]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = [prose(30) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(rnd.randint(5, 40)) for _ in range(rnd.randint(1, 4))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(shared)
            a = rnd.randint(0, len(p) // 2)
            parts.insert(rnd.randint(0, len(parts)), p[a : rnd.randint(a, len(p))])
        rows.append((rnd.randint(0, 500), rnd.choice([" ", "\n", ""]).join(parts), "en", "s", 1))
    base = rows[0][1] + prose(200)
    for i in range(25):  # near copies
        t = list(base)
        for _ in range(rnd.randint(0, 6)):
            t[rnd.randrange(len(t))] = rnd.choice("xyz")
        rows.append((600 + rnd.randint(0, 40), "".join(t), "en", "s", 1))
    rows += [(700, "a" * 400, "en", "s", 1), (701, "a" * 90 + "b" + "a" * 49, "en", "s", 1), (702, "ab" * 120, "en", "s", 1), (703, "ba" * 60, "en", "s", 1)]
    rows += [(704, "x" * 49, "en", "s", 1), (705, "x" * 50, "en", "s", 1), (706, "x" * 50, "en", "s", 1)]
    return rows


def test_matches_brute_force(spark):
    for rows in (awkward_rows(), planted(1), planted(2)):
        got = s.remove_repeats(frame(spark, rows).selectExpr("*", "1 as bucket", "2 as kind", "3 as key", "4 as order", "5 as raw")).collect()
        assert Counter(map(tuple, got)) == brute(rows)


def run_steps(rows, buckets=5):
    """The operator's steps on one batch of rows, without a session."""
    import pyarrow as pa
    import xxhash

    raws = [(r[1] or "").encode() for r in rows]
    keys = pa.array([xxhash.xxh64_intdigest(r) >> 1 for r in raws], pa.int64())
    order = pa.array([s.NO_ID if r[0] is None else r[0] for r in rows], pa.int64())
    batch = pa.RecordBatch.from_arrays([order, keys, pa.array(raws, pa.binary())], ["order", "key", "raw"])

    def by(batches, *key):
        batches = [b for b in batches if b.num_rows]
        return pa.Table.from_batches(batches).sort_by([(k, "ascending") for k in key]).to_batches() if batches else []

    def texts_and(codes, *kinds):
        nobody = pa.nulls
        home = pa.array(((order.to_numpy() ^ keys.to_numpy()) % buckets).astype(np.int32))
        names = ["home", "kind", "order", "key", "payload"]
        texts = pa.RecordBatch.from_arrays([home, pa.array([s._TEXT] * len(rows), pa.int32()), order, keys, batch.column(2)], names)
        codes = [c.filter(pa.compute.is_in(c.column("kind"), pa.array(kinds, pa.int32()))) for c in codes]
        none = lambda c: nobody(c.num_rows, pa.int64())
        return by([*[pa.RecordBatch.from_arrays([c.column(0), c.column(1), none(c), none(c), c.column(2)], names) for c in codes], texts], "home", "kind")

    matched = list(s._match_segments(buckets)(by(s._meeting(buckets)([batch]), "bucket")))
    parts = list(s._sort_suffixes(buckets)(by(s._contexts(buckets)(texts_and(matched, s._ASK)), "bucket")))
    got = Counter()
    for out in s._finish(texts_and([*matched, *parts], s._RUN, s._SAME, s._WINDOWS)):
        got.update(zip([None if i == s.NO_ID else i for i in out.column(0).to_pylist()], *[c.to_pylist() for c in out.columns[1:]]))
    return got


def test_chunks_batches_buckets_and_hot_anchors_do_not_matter(monkeypatch):
    rows = planted(3)
    assert run_steps(rows) == brute(rows)
    monkeypatch.setattr(s, "CHUNK", 64)
    monkeypatch.setattr(s, "SORT_ROWS", 40)
    for batch_bytes in (1500, 300):
        monkeypatch.setattr(s, "BATCH_BYTES", batch_bytes)
        for hot in (20_000, 3, 1):
            monkeypatch.setattr(s, "HOT_ENTRIES", hot)
            assert run_steps(rows) == brute(rows)


def test_equal_hashes_of_unequal_segments_cover_nothing(monkeypatch):
    rows = [(i, *r[1:]) for i, r in enumerate(planted(5))]
    own = s.segments

    def colliding(raw):
        first, last, at, anchor, ids = own(raw)
        return first, last, at, anchor, (ids & np.uint64(3 << 62)) | np.uint64(1 << 20)

    monkeypatch.setattr(s, "segments", colliding)
    monkeypatch.setattr(s, "BATCH_BYTES", 1500)
    assert run_steps(rows) == brute(rows)
    monkeypatch.setattr(s, "HOT_ENTRIES", 3)  # parts of a hot anchor compare with its smallest holder only: a collision may hide a match
    removed = lambda x: {r[0]: r[2] for r in x}
    most = removed(brute(rows))
    assert all(n <= most[i] for i, n in removed(run_steps(rows)).items())


def test_one_doc_id_with_several_texts():
    rows = planted(6)[:40]
    rows = [(i // 4, *r[1:]) for i, r in enumerate(rows)] + [(None, *r[1:]) for r in rows[:6]]
    assert run_steps(rows) == brute(rows)


def test_suffixes_sort_as_bytes_do_and_classes_are_verified():
    rnd = random.Random(4)
    raw = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(3000)) + b"ab" * 100, np.uint8)
    start = np.array(rnd.sample(range(len(raw) - 50), 900))
    group = np.sort(np.array([rnd.randrange(9) for _ in start]))
    sort = s.SuffixSort(raw)
    perm, cls = sort.classes(start, group)
    keys = [(g, raw[p : p + 50].tobytes()) for g, p in zip(group, start[perm])]
    assert keys == sorted(keys)
    assert all((cls[i] == cls[i - 1]) == (keys[i] == keys[i - 1]) for i in range(1, len(keys)))
    sort.h = np.zeros_like(sort.h)  # every hash collides: equal classes must still hold equal bytes
    perm, cls = sort.classes(start, group)
    keys = [(g, raw[p : p + 50].tobytes()) for g, p in zip(group, start[perm])]
    assert all(keys[i] == keys[i - 1] for i in range(1, len(keys)) if cls[i] == cls[i - 1])


def test_empty(spark):
    assert s.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
