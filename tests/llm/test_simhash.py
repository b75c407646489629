import random

import numpy as np
import pyarrow as pa
import xxhash

from data import SCHEMA, awkward_rows, frame
from skein.llm import simhash


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: list of (id, fp); component = smallest id."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(fps[i][0])
    return {find(i): min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))}, [find(i) for i in range(len(fps))]


def test_documents_match_brute_force(spark):
    rows = awkward_rows()
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()))
    fps = [(r[0], brute_fp(r[1])) for r in rows]
    names, at = brute_components(fps)
    assert got == sorted((i is None, i or 0, f, names[a]) for (i, f), a in zip(fps, at))


def test_edges_find_every_pair_also_in_split_cells(spark):
    rnd = random.Random(3)
    fps = {0, 2**64 - 1}
    for _ in range(150):
        f = rnd.getrandbits(64)
        for _ in range(6):
            fps.add(f)
            for _ in range(rnd.randint(1, 4)):
                f ^= 1 << rnd.randrange(64)
    hub = rnd.getrandbits(64)
    fps |= {hub ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f, (False, i, 0, f)) for i, f in enumerate(signed)], f"fp long, node {simhash.NODE}")
    names, at = brute_components(list(enumerate(fps)))
    want = {f: names[a] for f, a in zip(fps, at)}
    for cell_rows, tile in ((50_000, 512), (60, 16)):
        parent = {f: f for f in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        edges = simhash.fingerprint_edges(df, tile=tile, cell_rows=cell_rows).collect()
        for e in edges:
            a, b = find(e.src.fp % 2**64), find(e.dst.fp % 2**64)
            parent[max(a, b)] = min(a, b)
        groups = {}
        for f in fps:
            groups.setdefault(find(f), set()).add(want[f])
        assert all(len(g) == 1 for g in groups.values())
        assert len(groups) == len(set(want.values()))
        assert len(edges) < 25 * len(fps)


def test_tiles_of_one_key_apart_in_population_are_skipped():
    run = simhash._compare_tiles(3, 4)
    fp = np.array([1, 3, 7, 15] + [2**40 - 1 - (1 << i) for i in range(4)], np.uint64).view(np.int64)
    node = pa.array([{"none": False, "doc_id": i, "text_key": 0, "fp": int(f)} for i, f in enumerate(fp)])
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(8, np.int64)), pa.array(fp), node], ["cell", "fp", "node"])
    edges = [(a["fp"], b["fp"]) for out in run(iter([batch])) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    assert {frozenset(e) for e in edges} <= {frozenset((int(a), int(b))) for a in fp for b in fp if bin(int(a) ^ int(b)).count("1") <= 3 and a != b}


def test_one_doc_id_with_two_texts_does_not_join_their_groups(spark):
    rnd = random.Random(5)
    a, b = (" ".join(f"{c}{rnd.randrange(999)}" for _ in range(200)) for c in "xy")
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (3, a, "en", "s", 1), (9, b, "en", "s", 1), (None, b, "en", "s", 1)]
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [(-1, 5), (3, 3), (5, 3), (5, 5), (9, 5)]


def test_one_of_each_and_empty(spark):
    docs = frame(spark).selectExpr("*", "1 as fp", "2 as node")
    kept = simhash.one_of_each(docs, simhash.near_duplicates(docs))
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and kept.columns == docs.columns
    assert 0 in ids and 12 not in ids and 13 not in ids
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
