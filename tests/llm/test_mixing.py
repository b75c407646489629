import re
from collections import Counter

from pyspark.sql import Row

from data import SCHEMA, awkward_rows, frame
from skein.llm.mixing import mix, repeated

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        free = sum(w[s] for s in order if s not in full)
        t = {s: 3 * sizes[s] if s in full else left * w[s] / free for s in order}
        over = {s for s in order if t[s] > 3 * sizes[s]}
        if not over:
            return t
        full |= over


def check(rows, got):
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    got = [Row(**r.doc.asDict(), **{k: v for k, v in r.asDict().items() if k != "doc"}) for r in got]
    want = brute_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    took, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        took[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(took[s] - want[s]) <= largest[s]
    return took, want


def test_targets_and_taken_words(spark):
    rows = awkward_rows()
    check(rows, mix(frame(spark, rows)).collect())


def test_many_documents_come_within_a_percent_and_reruns_agree(spark):
    rows = [(i, "w " * (5 + i * i % 97 + (900 if i % 50 == 0 else 0)), "en", "hot" if i % 3 else f"s{i % 11}", 1) for i in range(4000)]
    rows += [(9000 + i, "w " * 3, "en", None, 1) for i in range(40)]
    a = mix(frame(spark, rows)).collect()
    took, want = check(rows, a)
    assert all(abs(took[s] - want[s]) <= 0.02 * want[s] for s in took)
    assert Counter(map(tuple, a)) == Counter(map(tuple, mix(frame(spark, rows).repartition(5)).collect()))


def test_ties_do_not_break_the_target(spark):
    for own in (None, 7):
        rows = [(own, "ten words of text that are all the same here", "en", "a", 1) for _ in range(1000)]
        rows += [(10_000 + i, "w " * 10, "en", "b", 1) for i in range(1000)]
        took, want = check(rows, mix(frame(spark, rows).repartition(7)).collect())
        assert all(abs(took[s] - want[s]) <= 10 for s in took)


def test_repeated_rows_and_empty(spark):
    docs = frame(spark).selectExpr("*", "1 as copies", "2 as s", "3 as target", "4 as doc", "5 as size", "6 as row", "7 as u")
    m = mix(docs)
    rows = repeated(m)
    assert rows.columns == docs.columns and rows.dtypes == docs.dtypes
    want = sum(r.copies for r in m.collect())
    assert rows.count() == want
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert repeated(mix(spark.createDataFrame([], SCHEMA))).count() == 0
