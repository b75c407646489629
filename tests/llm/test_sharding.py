import zlib
from collections import Counter

from data import SCHEMA, awkward_rows, frame
from skein.llm.sharding import shard


def check(rows, got, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for s in range(shards):
        assert abs(sum(r.size for r in by.get(s, [])) - total / shards) <= largest


def test_bytes_are_even_and_slots_gapless(spark):
    rows = awkward_rows()
    check(rows, shard(frame(spark, rows), 4).collect(), 4)


def test_hot_text_is_spread_and_ranges_subdivide(spark):
    rows = [(i, "one hot text " * 20 if i % 3 else f"text number {i} " * (i % 40 + 1), "en", "s", 1) for i in range(3000)]
    a = shard(frame(spark, rows), 24).collect()
    check(rows, a, 24)
    b = shard(frame(spark, rows).repartition(7), 24, ranges_per_shard=3).collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))  # neither sample nor layout decides


def test_equal_texts_share_a_shard_where_they_fit(spark):
    rows = [(i, f"group {i // 4} " * 50, "en", "s", 1) for i in range(800)]
    by = {}
    for r in shard(frame(spark, rows), 8).collect():
        by.setdefault(r.doc_id // 4, set()).add(r.shard)
    assert sum(len(s) > 1 for s in by.values()) <= 7


def test_empty(spark):
    assert shard(spark.createDataFrame([], SCHEMA)).count() == 0
