import random
import zlib

import numpy as np
from data import SCHEMA, awkward_rows, frame
from skein.llm import toxicity as t

LABELS = "doc_id long, quality int, toxic int"
WORDS = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "ginkgo", "hazel", "ivy", "juniper", "kapok", "larch"]


def text(rnd, insult, group):
    w = [rnd.choice(WORDS) for _ in range(rnd.randint(5, 40))]
    w += ["rotten"] * insult + ["villagers"] * group
    rnd.shuffle(w)
    return " ".join(w)


def test_learns_a_pair_that_additive_weights_miss(spark):
    rnd = random.Random(0)
    cases = [(rnd.random() < 0.5, rnd.random() < 0.5) for _ in range(1600)]
    rows = [(i, text(rnd, a, b), "en", "s", 1) for i, (a, b) in enumerate(cases)]
    labels = spark.createDataFrame([(i, 1, int(a != b)) for i, (a, b) in enumerate(cases)], LABELS)
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in t.score(docs, t.train(docs, labels)).collect()}
    test = [i for i in range(1600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(test)) for i in range(1600))
    right = np.mean([got[i].predicted == (cases[i][0] != cases[i][1]) for i in test])
    assert right > 0.95
    x = [t.term_columns(r[1]) for r in rows]
    y = np.array([float(a != b) for a, b in cases])
    flat = t.fit(x, y, factors=0)
    at = flat.place()
    margins = flat.margins([(k := at[r])[k >= 0] for r in x])
    assert np.mean((t.sigmoid(margins) >= 0.5) == y) < 0.8


def test_learns_a_pair_among_thousands_of_words():
    rnd = random.Random(4)
    words = ["w" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(3000)]
    cases = [(rnd.random() < 0.5, rnd.random() < 0.5) for _ in range(4000)]
    rows = []
    for a, b in cases:
        rows.append(t.term_columns(" ".join([rnd.choice(words) for _ in range(rnd.randint(5, 40))] + ["rotten"] * a + ["villagers"] * b)))
    y = np.array([float(a != b) for a, b in cases])
    model = t.fit(rows[:3000], y[:3000])
    assert len(model.columns) > 3000
    at = model.place()
    got = t.sigmoid(model.margins([(k := at[r])[k >= 0] for r in rows[3000:]])) >= t.THRESHOLD
    assert np.mean(got == y[3000:]) > 0.9


def test_margin_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = t.Machine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 4)))
    for row in ([0, 2, 5], [1], [], [0, 1, 2, 3, 4, 5]):
        want = 0.3 + sum(m.w[i] for i in row) + sum(m.v[i] @ m.v[j] for i in row for j in row if i < j)
        assert abs(m.margins([np.array(row, np.int32)])[0] - want) < 1e-9


def test_awkward_rows_and_reruns(spark):
    docs = frame(spark).selectExpr("*", "1 as toxic", "2 as l_id")
    labels = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (1, 1, 0), (2, None, None), (None, 1, 1), (3, 0, 0)], LABELS)
    a = sorted(map(str, t.score(docs, t.train(docs, labels)).collect()))
    b = sorted(map(str, t.score(docs, t.train(docs.repartition(3), labels)).collect()))
    assert a == b and len(a) == len(awkward_rows())
    none = spark.createDataFrame([], LABELS)
    got = t.score(docs, t.train(docs, none)).collect()
    assert all(r.score == 0.5 for r in got)
    assert t.score(spark.createDataFrame([], SCHEMA), t.train(docs, labels)).count() == 0


def plain_fit(rows, y, factors, epochs):
    """The same training in loops over documents and pairs of terms."""
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    w0 = np.log(share / (1 - share))
    held = {}
    for r in rows:
        for c in set(r.tolist()):
            held[c] = held.get(c, 0) + 1
    columns = sorted(c for c, k in held.items() if t.LEAST_DOCS <= k < n)
    rng = np.random.default_rng(t.SEED)
    w = dict.fromkeys(columns, 0.0)
    start = rng.normal(0, 0.01, (len(columns), factors))
    v = {c: start[i].copy() for i, c in enumerate(columns)}
    g0, gw, gv = 1e-8, dict.fromkeys(columns, 1e-8), {c: np.full(factors, 1e-8) for c in columns}
    rows = [[c for c in r.tolist() if c in w] for r in rows]
    noise = {c: np.sqrt(held[c]) / n for c in columns}

    def margin(r, pairs):
        return w0 + sum(w[c] for c in r) + (sum(v[a] @ v[b] for i, a in enumerate(r) for b in r[:i]) if pairs else 0.0)

    for epoch in range(2 * epochs):
        pairs = epoch >= epochs
        order = rng.permutation(n)
        for a in range(0, n, t.BATCH):
            part = order[a : a + t.BATCH]
            err = {i: (1 / (1 + np.exp(-margin(rows[i], pairs))) - y[i]) / len(part) for i in part}
            g = sum(err.values())
            g0 += g * g
            w0 -= t.RATE * g / np.sqrt(g0)
            used = sorted({c for i in part for c in rows[i]})
            dw = {c: sum(err[i] for i in part if c in rows[i]) for c in used}
            rate = {}
            for c in used:
                gw[c] += dw[c] ** 2
                rate[c] = t.RATE / np.sqrt(gw[c])
            move = [sum(rate[c] * dw[c] for c in rows[i]) for i in part]
            scale = min(1.0, t.W_MOVE / np.sqrt(np.mean(np.square(move)) + 1e-12))
            for c in used:
                x = w[c] - scale * rate[c] * dw[c]
                w[c] = np.sign(x) * max(abs(x) - scale * rate[c] * t.W_PENALTY * noise[c], 0)
            if not pairs:
                continue
            step = {}
            for c in used:
                dv = sum(err[i] * (sum(v[o] for o in rows[i]) - v[c]) for i in part if c in rows[i]) + t.V_PENALTY * noise[c] * v[c]
                gv[c] += dv**2
                step[c] = t.RATE * dv / np.sqrt(gv[c])
            both = lambda r, f: sum(f(x) @ f(z) for i, x in enumerate(r) for z in r[:i])
            move = [both(rows[i], lambda c: v[c]) - both(rows[i], lambda c: v[c] - step[c]) for i in part]
            scale = min(1.0, t.V_MOVE / np.sqrt(np.mean(np.square(move)) + 1e-12))
            for c in used:
                v[c] = v[c] - scale * step[c]
    return w0, np.array([w[c] for c in columns]), np.array([v[c] for c in columns])


def test_fit_equals_plain_loops():
    rnd = random.Random(9)
    rows = [np.array(sorted(rnd.sample(range(30), rnd.randint(0, 8))), np.int32) for _ in range(300)]
    y = np.array([float((3 in r) != (5 in r)) for r in rows])
    got = t.fit(rows, y, factors=3, epochs=2)
    w0, w, v = plain_fit(rows, y, 3, 2)
    assert abs(got.w0 - w0) < 1e-8 and np.allclose(got.w, w, atol=1e-8) and np.allclose(got.v, v, atol=1e-8)


def test_repeated_rows_of_one_doc_id_do_not_pass_the_bound(spark, monkeypatch):
    rows = [(1, f"alder birch word{i % 7}", "en", "s", 1) for i in range(500)] + [(3, "cedar elm", "en", "s", 1)]
    labels = spark.createDataFrame([(1, 1, 1), (3, 1, 0)], LABELS)
    seen = []
    monkeypatch.setattr(t, "fit", lambda rows, y: seen.append(len(rows)))
    t.train(frame(spark, rows), labels, most_rows=40)
    assert seen == [40]


def test_sums_of_a_batch():
    rnd = np.random.default_rng(4)
    rows = [np.unique(rnd.integers(0, 1 << t.HASH_BITS, 300).astype(np.int32) % 40_000) for _ in range(256)]
    flat, doc = t._flat(rows)
    used = np.unique(flat)
    batch = t._Batch(np.searchsorted(used, flat), doc, len(rows) + 1, len(used))
    x, z = rnd.normal(size=len(used)), rnd.normal(size=len(rows) + 1)
    held = [np.searchsorted(used, r) for r in rows]
    assert np.allclose(batch.by_row(x), [x[h].sum() for h in held] + [0.0])
    want = np.zeros(len(used))
    for i, h in enumerate(held):
        want[h] += z[i]
    assert np.allclose(batch.by_column(z), want)


def test_only_the_kept_columns_travel():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 0], pa.int32()), pa.array([[3, 5, 9], []], pa.list_(pa.int32()))], ["toxic", "terms"])
    (out,) = t._only(np.array([3, 9], np.int32))(iter([batch]))
    assert [np.frombuffer(x, np.int32).tolist() for x in out.column("terms").to_pylist()] == [[3, 9], []]


def test_rows_keep_their_order_in_one_buffer():
    rnd = random.Random(3)
    long = bytes(80)
    rows = [(rnd.choice([b"", long, long + b"ab", b"q" * rnd.randint(0, 90)]), rnd.randint(0, 1)) for _ in range(200)]
    flat, ends = b"".join(r for r, _ in rows), [0]
    for r, _ in rows:
        ends.append(ends[-1] + len(r))
    order = t.in_order(flat, ends, [y for _, y in rows])
    assert sorted(order) == list(range(200)) and [rows[i] for i in order] == sorted(rows)


def test_training_rows_are_not_collected_at_once(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(self):
        raise AssertionError("all rows at once")

    monkeypatch.setattr(DataFrame, "collect", refuse)
    rows = [(i, f"alder birch {WORDS[i % 12]}", "en", "s", 1) for i in range(60)]
    model = t.train(frame(spark, rows), spark.createDataFrame([(i, 1, i % 2) for i in range(60)], LABELS))
    assert len(model.columns)
