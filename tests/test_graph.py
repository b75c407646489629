import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.functions import text
from skein.graph import Graph, edges_of, nodes_of
from skein.operators import analyze, build, cluster, resolve, search, traverse


def graph(spark, ids, edges, **attrs):
    nodes = [{"id": i, "label": attrs.get("labels", {}).get(i, i), "source_file": "test.rs", "node_type": "class", "community": attrs.get("communities", {}).get(i)} for i in ids]
    rows = [dict(zip(("source", "target", "relation", "weight"), (*e, "calls", 1.0)[:2] + ((e[2] if len(e) > 2 else "calls"), e[3] if len(e) > 3 else 1.0))) for e in edges]
    return Graph(nodes_of(spark, nodes), edges_of(spark, rows))


def test_star_ranks_its_centre_first(spark):
    g = graph(spark, ["center", *[f"leaf{i}" for i in range(5)]], [("center", f"leaf{i}") for i in range(5)])
    top = traverse.pagerank(g, 6).collect()
    assert top[0].id == "center" and top[0].rank > top[1].rank
    assert abs(sum(r.rank for r in top) - 1) < 1e-6
    assert analyze.god_nodes(g, 1).first().id == "center"


def test_cycles(spark):
    assert traverse.detect_cycles(graph(spark, "abc", ["ab", "bc"])).count() == 0
    found = traverse.detect_cycles(graph(spark, "abcd", ["ab", "bc", "ca", "cd"])).collect()
    assert [(r.length, round(r.severity, 6), r.cycle) for r in found] == [(3, round(1 / 3, 6), "a > b > c")]


def test_bridge(spark):
    g = graph(spark, ["a", "b", "bridge", "c"], [("bridge", "a"), ("bridge", "b"), ("bridge", "c")], communities={"a": 0, "b": 0, "bridge": 0, "c": 1})
    got = {r.id: r for r in analyze.community_bridges(g).collect()}
    assert (got["bridge"].cross_edges, got["bridge"].total_edges, got["bridge"].touched) == (1, 3, [0, 1])
    assert got["c"].bridge_ratio == 1.0 and "a" not in got


def test_cohesion(spark):
    g = graph(spark, "abc", ["ab"], communities=dict.fromkeys("abc", 0))
    assert analyze.cohesion(g).first().cohesion == 0.33


def test_communities(spark):
    def groups(g):
        out = {}
        for r in cluster.communities(g).collect():
            out.setdefault(r.community, set()).add(r.id)
        return sorted(map(sorted, out.values()))

    cliques = [(f"{c}{i}", f"{c}{j}") for c in "ab" for i in (1, 2, 3) for j in (1, 2, 3) if i < j]
    ids = [f"{c}{i}" for c in "ab" for i in (1, 2, 3)]
    assert groups(graph(spark, ids, cliques)) == [["a1", "a2", "a3"], ["b1", "b2", "b3"]]
    assert sum(map(len, groups(graph(spark, ids, [*cliques, ("a3", "b1")])))) == 6
    assert groups(graph(spark, "abc", [])) == [["a"], ["b"], ["c"]]


def test_remap_keeps_numbers(spark):
    new = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 2)], "id string, community long")
    old = spark.createDataFrame([("a", 5), ("b", 5), ("c", 0), ("x", 1)], "id string, community long")
    assert {r.id: r.community for r in cluster.remap(new, old).collect()} == {"a": 5, "b": 5, "c": 0, "d": 1}


def test_walks(spark):
    g = graph(spark, "abcdez", [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e", "calls", 0.1), ("e", "d", "calls", 0.1)])
    assert {r.id: r.depth for r in traverse.bfs(g, ["a"], 2).collect()} == {"a": 0, "b": 1, "e": 1, "c": 2, "d": 2}
    assert traverse.bfs(g, ["a"], 0).count() == 1
    assert traverse.shortest_path(g, "a", "d") == ["a", "e", "d"]
    assert traverse.shortest_path(g, "a", "a") == ["a"] and traverse.shortest_path(g, "a", "z") is None
    path, cost = traverse.weighted_path(g, "a", "d")
    assert path == ["a", "b", "c", "d"] and cost == pytest.approx(3.0)
    assert [r.path for r in traverse.simple_paths(g, "a", "d", 3).collect()] == ["a > e > d", "a > b > c > d"]
    assert {r.id: r.component for r in traverse.connected_components(g).collect()} == {**dict.fromkeys("abcde", "a"), "z": "z"}


def test_build_and_diff(spark):
    a = graph(spark, "ab", ["ab"])
    b = graph(spark, "bc", ["bc", "bx"], labels={"b": "other"})
    g = build.build([a, b])
    assert {r.id: r.label for r in g.nodes.collect()} == {"a": "a", "b": "b", "c": "c"} and g.edges.count() == 2
    d = {(r.kind, r.change, r.source) for r in build.graph_diff(a, g).collect()}
    assert d == {("node", "added", "c"), ("edge", "added", "b")}
    assert build.shrinks(g, a) and not build.shrinks(a, g)


def test_graft_and_prune(spark):
    store, _ = build.merge_graphs([("x", graph(spark, "ab", ["ab"], communities={"a": 0, "b": 0}))], namespaced=True)
    g = build.graft(store, graph(spark, "cd", ["cd"], communities={"c": 0, "d": 0}), "y")
    assert {(r.id, r.community) for r in g.nodes.collect()} == {("x::a", 0), ("x::b", 0), ("y::c", 1), ("y::d", 1)}
    assert build.prune_repo(g, "x").nodes.count() == 2


def test_three_way(spark):
    t = lambda rows: spark.createDataFrame(rows, "k string, v int")
    base, ours, theirs = t([("same", 1), ("o", 1), ("t", 1), ("both", 1), ("del", 1)]), t([("same", 1), ("o", 2), ("t", 1), ("both", 2), ("new", 9)]), t([("same", 1), ("o", 1), ("t", 3), ("both", 3), ("del", 5)])
    got = {r.k: (r.v, r._conflict) for r in build.three_way(base, ours, theirs, ["k"]).collect()}
    assert got == {"same": (1, False), "o": (2, False), "t": (3, False), "both": (2, True), "new": (9, False)}


def test_entity_resolution(spark):
    rows = [("a1", "Widget", "src/foo.rs"), ("a2", "widget", "src/foo.rs"), ("b1", "Widget", "src/bar.rs"), ("s1", "getActiveSession", "x.doc"), ("s2", "getActiveSessions", "y.doc"),
            ("g1", "Incremental Graph Extractor Pipeline Manager", "z.doc"), ("g2", "Incremental Graph Extractor Pipeline Managre", "z.doc")]
    nodes = nodes_of(spark, [{"id": i, "label": lab, "source_file": f, "node_type": "concept"} for i, lab, f in rows])
    g, merged = resolve.resolve_entities(Graph(nodes, edges_of(spark, [{"source": "a2", "target": "b1", "relation": "uses"}])))
    assert {r.id: r.survivor for r in merged.collect()} == {"a2": "a1", "g2": "g1"}
    assert [(e.source, e.target) for e in g.edges.collect()] == [("a1", "b1")]


def test_string_metrics():
    assert 100 * resolve.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(96.11, abs=0.01)
    bands, rows = resolve.lsh_parameters()
    assert bands * rows <= 128 and 0.5 < (1 / bands) ** (1 / rows) < 0.8


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(text.make_id(lit("__foo__"), lit("..bar.."))) == "foo_bar"
    assert one(text.make_id(lit("my-class"), lit("method()"))) == "my_class_method"
    assert one(text.make_id(lit("类名::方法"))) == "类名_方法" and one(text.make_id(lit("---"))) == ""
    assert one(text.search_tokens(lit("std::collections::HashMap"))) == ["std", "collections", "hash", "map"]
    assert one(text.search_tokens(lit("HTTPServer"))) == ["httpserver"]
    assert one(text.norm(lit("Foo::Bar__baz"))) == "foo bar baz"
    assert one(text.entropy(lit("aaaaa"))) < 2.5 < one(text.entropy(lit("Graph Extractor")))
    assert one(text.is_test_file(lit("src/Tests/Utils.rs"))) and not one(text.is_test_file(lit("latest_data.go"))) and not one(text.is_test_file(lit("testing_utils.rs")))
    assert one(text.rationale(lit("x = 1 # NOTE: this is deliberate for perf"), "python")) == "NOTE: this is deliberate for perf"
    assert one(text.document_references(lit("see ADR-7, adr 0007 and RFC 2119"))) == ["ADR-0007", "RFC 2119"]
    assert one(text.normalize_path(lit("a/./b/../c//d"))) == "a/c/d"
    assert one(text.link_targets(lit("[a](b.md#x) [c](https://x) [[Wiki Page|w]] \n[r]: d%20e.md"))) == ["b.md", "d e.md", "Wiki Page"]
    for url, safe in (("http://example.com/x", True), ("http://127.0.0.1/", False), ("http://2130706433/", False), ("http://0x7f000001/", False), ("http://10.1.2.3:80", False), ("ftp://example.com", False), ("http://localhost/", False), ("http://8.8.8.8/", True)):
        assert one(text.is_safe_url(lit(url))) == safe, url


def test_search(spark):
    g = graph(spark, ["auth", "user", "db", "cache"], [("auth", "user"), ("auth", "db"), ("user", "db"), ("user", "cache")], labels={"auth": "AuthService", "user": "UserManager", "db": "Database", "cache": "CacheLayer"})
    assert search.search(g, ["auth"]).first().id == "auth"
    assert {r.id for r in search.query_graph(g, "the auth service", depth=1).collect()} == {"auth", "user", "db"}
    assert search.resolve_label(g, "userM").first().id == "user"
    assert search.is_ambiguous(search.resolve_label(g, "a")).count() == 1
    assert {(r.direction, r.relation, r.n) for r in search.explain(g, "user").collect()} == {("in", "calls", 1), ("out", "calls", 2)}


def test_walks_run_to_their_end(spark):
    n = 66  # more steps than any fixed number of rounds that would do for small graphs
    ids = [f"n{i:03d}" for i in range(n)]
    g = Graph(nodes_of(spark, [{"id": i} for i in ids]), edges_of(spark, [{"source": a, "target": b, "relation": "calls", "weight": 2.0} for a, b in zip(ids, ids[1:])]))
    few = Graph(g.nodes, g.edges.where(f"source < '{ids[20]}'"))
    assert traverse.shortest_path(g, ids[0], ids[-1]) == ids
    path, cost = traverse.weighted_path(few, ids[0], ids[15])
    assert path == ids[:16] and abs(cost - 7.5) < 1e-9


def test_depth_first_walk_marks_when_it_stacks(spark):
    pairs = [("a", "b"), ("a", "c"), ("c", "b"), ("b", "d"), ("d", "e")]
    g = Graph(nodes_of(spark, [{"id": i} for i in "abcde"]), edges_of(spark, [{"source": a, "target": b, "relation": "calls"} for a, b in pairs]))
    walk = lambda depth: [(r.id, r.depth) for r in traverse.dfs(g, ["a"], depth).orderBy("place").collect()]
    assert walk(2) == [("a", 0), ("c", 1), ("b", 1), ("d", 2)]
    assert walk(0) == [("a", 0)] and traverse.dfs(g, ["x"], 2).count() == 0


def test_equally_short_paths_are_ordered_as_joined_text(spark):
    # "b1|..." comes after "b10|...", as "|" comes after the digits.
    g = graph(spark, ["a", "b1", "b10", "z"], [("a", "b1"), ("a", "b10"), ("b1", "z"), ("b10", "z")])
    assert traverse.shortest_path(g, "a", "z") == ["a", "b10", "z"]
    piped = graph(spark, ["a", "b|c", "z"], [("a", "b|c"), ("b|c", "z")])
    assert traverse.shortest_path(piped, "a", "z") == ["a", "b|c", "z"]


def test_scores_of_long_labels_take_work_by_their_length(spark):
    import time

    a, b = "the quick brown fox " * 2000, "a quick brown dog " * 2200
    began = time.process_time()
    assert 0.6 < resolve.jaro(a, b) < 1  # 40,000 characters; minutes when every place in reach is looked at
    assert time.process_time() - began < 5
    df = spark.createDataFrame([("ab c",), ("a b",), ("",), ("abcabca",), ("xéy😀z",)], "t string")
    got = [sorted(r.s) for r in df.select(text.shingles(F.col("t")).alias("s")).collect()]
    assert got == [["abc"], ["ab"], [""], ["abc", "bca", "cab"], sorted(["xéy", "éy😀", "y😀z"])]
    assert [round(r.e, 6) for r in df.select(text.entropy(F.col("t")).alias("e")).collect()] == [2.0, round(1.584962500721156, 6), 0.0, 1.556657, 2.321928]


def test_communities_do_not_hold_the_edges(monkeypatch):
    rnd = random.Random(3)
    pairs = sorted({tuple(sorted(rnd.sample(range(250), 2))) if rnd.random() < 0.8 else (rnd.randrange(250), 250 + rnd.randrange(250)) for _ in range(60_000)})
    batches = lambda n: (pa.RecordBatch.from_pydict({"a": [7 + a for a, _ in p], "b": [7 + b for _, b in p], "w": [float(1 + (a + b) % 5) for a, b in p]}) for p in (pairs[i : i + n] for i in range(0, len(pairs), n)))
    m = float(sum(1 + (a + b) % 5 for a, b in pairs))

    def moved(block, of):
        monkeypatch.setattr(cluster, "BLOCK", block)
        return [(n, low) for b in cluster._moved_batches(m, 500)(of) for n, low in zip(*(b.column(x).to_pylist() for x in ("n", "low")))]

    whole = moved(1 << 18, batches(len(pairs)))
    assert len(whole) == 500 and all(low <= n for n, low in whole)
    shuffled = list(batches(300))
    rnd.shuffle(shuffled)
    tracemalloc.start()
    try:
        assert moved(500, iter(shuffled)) == whole
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(pairs) > 25_000 and peak < 40 * len(pairs)
    assert list(cluster._moved_batches(1.0, 0)(iter([]))) == []


def test_communities_find_components_by_numbers(spark, monkeypatch):
    kinds, one = [], cluster._components
    monkeypatch.setattr(cluster, "_components", lambda e, *ends: kinds.extend(k for _, k in e.select(*ends).dtypes) or one(e, *ends))
    got = {r.id: r.community for r in cluster.communities(graph(spark, "abcdef", ["ad", "dc", "be", "gf"])).collect()}
    assert kinds == ["bigint", "bigint"] and [got[i] for i in "acdbef"] == [0, 0, 0, 1, 1, 2]
    far = pa.RecordBatch.from_pydict({"a": [5, 70_000_000], "b": [40_000_000, 70_000_001], "w": [1.0, 1.0]})
    tracemalloc.start()
    try:
        rows = [r for b in cluster._moved_batches(2.0, 4)(iter([far])) for r in zip(*(b.column(x).to_pylist() for x in ("n", "low")))]
        assert rows == [(5, 5), (40_000_000, 5), (70_000_000, 70_000_000), (70_000_001, 70_000_000)] and tracemalloc.get_traced_memory()[1] < 30_000_000
    finally:
        tracemalloc.stop()
