import numpy as np
from skein.llm import embed_dedup as e

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=e.COSINE):
    n = len(rows)
    links = [set() for _ in range(n)]
    x = [None] * n
    for i, (_, v, lab) in enumerate(rows):
        if lab is not None and v and None not in v:
            a = np.array(v, np.float32).astype(float)
            if np.isfinite(a).all() and a.any():
                x[i] = a / np.linalg.norm(a)
    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= cosine:
                links[i].add(j)
                links[j].add(i)
    comp = [None] * n
    for i in range(n):
        if comp[i] is None:
            group, todo = {i}, [i]
            while todo:
                for k in links[todo.pop()] - group:
                    group.add(k)
                    todo.append(k)
            low = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
            for k in group:
                comp[k] = low if len(group) > 1 else rows[k][0]
    return [len(s) for s in links], comp, links


def sample(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(120, 16))
    rows = []
    for i in range(400):
        v = base[rng.integers(120)] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2, 0.3])
        rows.append((int(i), [float(a) for a in v.astype(np.float32)], int(i % 3)))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(40)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [float("inf")] + [1.0] * 15, 1)]
    rows += [(2005, rows[0][1], None), (2006, [None] + [1.0] * 15, 1), (2007, rows[0][1][:5], 0), (2008, rows[0][1][:5], 0), rows[7], (None, rows[9][1], rows[9][2])]
    return rows


def test_recall_against_brute_force(spark):
    rows = sample()
    counts, comp, links = brute(rows)
    got = e.near_duplicates(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as node", "2 as key", "3 as copies", "4 as class", "5 as h1")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    want = {}
    for (i, *_), n, c in zip(rows, counts, comp):
        want.setdefault(i, []).append((n, c, i is not None and i == c))
    found = sum(n for v in by.values() for n, *_ in v)
    assert found <= sum(counts) and found >= 0.98 * sum(counts)
    same = sum(sorted(by[i], key=str) == sorted(want[i], key=str) for i in want)
    assert same >= 0.97 * len(want)
    for i in (2000, 2001, 2002, 2003, 2004, 2005, 2006):
        assert by[i] == [(0, i, True)]


def test_split_buckets_count_once(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=32)
    rows = [(i, [float(a) for a in (centre + rng.normal(size=32) * 0.02).astype(np.float32)], 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    classes = df.selectExpr("named_struct('none', false, 'vec_id', vec_id, 'h1', vec_id, 'h2', 0L) node", "label", "embedding", "1L copies")
    for cell_rows in (4000, 40):
        got = e.link_counts(classes, cell_rows=cell_rows).groupBy("node").sum("links").collect()
        assert len(got) == 300 and all(r[1] == 299 for r in got)


def test_one_vec_id_with_two_vectors_does_not_join_their_groups(spark):
    x, y = [1.0] + [0.0] * 7, [0.0] * 7 + [1.0]
    rows = [(5, x, 1), (5, y, 1), (3, x, 1), (9, y, 1), (None, y, 1)]
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in e.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, 2, 5), (3, 1, 3), (5, 1, 3), (5, 2, 5), (9, 2, 5)]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    y = e.hadamard(x)
    assert np.allclose((x * x).sum(axis=1), (y * y).sum(axis=1)) and np.allclose(e.hadamard(y), x)


def test_empty(spark):
    assert e.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
