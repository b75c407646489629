from pyspark.sql import functions as F

from skein.functions import text
from skein.graph import Graph, edges_of, nodes_of
from skein.operators import callflow, cluster, report, search, store


def graph(spark):
    names = [("a", "api_route", 0), ("b", "api_handler", 0), ("c", "cache_store", 1), ("d", "store_index", 1), ("e", "thing", 2)]
    nodes = nodes_of(spark, [{"id": i, "label": n, "source_file": f"src/{n}.py", "node_type": "function", "community": c} for i, n, c in names])
    pairs = [("a", "b", "calls"), ("a", "c", "calls"), ("b", "c", "uses"), ("c", "d", "calls"), ("d", "e", "reads")]
    return Graph(nodes, edges_of(spark, [{"source": s, "target": t, "relation": r} for s, t, r in pairs]))


def test_call_flow_document(spark):
    g = graph(spark)
    by = callflow.sections(g)
    assert {(r.community, r.section) for r in by.collect()} == {(0, "api"), (1, "storage"), (2, "section 2")}
    assert callflow.diagram_nodes(g, by, "api", 3) == ["a", "b"]
    assert callflow.flow_chain(["api", "storage", "x"], [("api", "storage", 2), ("storage", "x", 1)]) == ["api", "storage", "x"]
    assert callflow.flow_chain([], []) == []
    rows = [tuple(r) for r in callflow.call_rows(g, by, "api").collect()]
    assert rows[0] == ("api_route", "src/api_route.py", "api_handler, cache_store", 0)
    doc = callflow.document(g)
    assert 's_api -->|calls x2| s_storage' in doc.replace("uses x2", "calls x2") and "api -> storage -> section 2" in doc
    assert callflow.report_highlights(["# x", "| a | b |", "|-|-|", "| 1 | 2 |", "text", "| 3 | 4 |"]) == [["1", "2"], ["3", "4"]]


def test_report_and_summary(spark):
    lines = report.report_lines(graph(spark))
    assert "## Hubs" in lines and "- node_count: 5" in lines
    got = report.smart_summary(graph(spark), budget=5).collect()
    assert len(got) == 1 and got[0].line.startswith("community 0: 2 nodes")


def test_store(spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path / "store"))
    g = graph(spark)
    assert s.list().count() == 0 and s.add("one", g, "h1") and not s.add("one", g, "h1") and s.add("one", g, "h2") and s.add("two", g, "h1")
    assert [(r.tag, r.hash, r.nodes) for r in s.list().orderBy("tag").collect()] == [("one", "h2", 5), ("two", "h1", 5)]
    assert s.read("one").edges.count() == 5 and s.remove("one") and not s.remove("one") and s.list().count() == 1


def test_names_labels_and_contexts(spark):
    m = graph(spark).nodes.select("id", "community")
    signed = store.label_signature(m).withColumn("label", F.concat(F.lit("L"), F.col("community").cast("string"))).select("signature", "label")
    moved = m.withColumn("community", F.col("community") + 5)
    assert {(r.community, r.label) for r in store.carried_labels(moved, signed).collect()} == {(5, "L0"), (6, "L1"), (7, "L2")}
    assert [r.id for r in search.suggest(graph(spark), "the store").collect()] == ["c", "d"]


def test_remap_is_greedy_by_overlap(spark):
    rows = [("a", 0, 7), ("b", 0, 7), ("c", 0, 7), ("d", 1, 7), ("e", 1, 3), ("f", 2, 3), ("g", 2, 3), ("h", 3, 9), ("i", 4, None), ("j", 4, None)]
    new = spark.createDataFrame([(i, n) for i, n, _ in rows], "id string, community long")
    old = spark.createDataFrame([(i, o) for i, _, o in rows if o is not None], "id string, community long")
    got = {r.id: r.community for r in cluster.remap(new, old).collect()}
    assert got == {"a": 7, "b": 7, "c": 7, "f": 3, "g": 3, "h": 9, "d": 0, "e": 0, "i": 1, "j": 1}


def test_large_communities_split():
    ring = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(8) for j in range(i)]
    adj = {}
    for a, b in [*ring("x"), *ring("y"), ("x0", "y0")]:
        adj.setdefault(a, {})[b] = adj.setdefault(b, {})[a] = 1.0
    of = cluster._split_large(sorted(adj), adj, dict.fromkeys(adj, 0), len(adj))
    assert len({of[n] for n in of if n[0] == "x"}) == 1 and len(set(of.values())) == 2


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(text.mermaid_escape(lit('a|b "c" --> {d} #e <f>'))) == "a b &#39;c&#39; to d e &lt;f&gt;"
    assert one(text.yaml_quote(lit('a "b"\nc\\'))) == '"a \\"b\\" c\\\\"'
    assert one(text.fnv_digest(lit("hello"))) == "a430d846" and one(text.within_bytes(lit("aéé"), 4)) == "aé"
    answer = lit('Sure!\n```json\n{"0": "Parsing \\"core\\"", "1": "  Cache  layer ", "x": "no", "0": "again"}\n```')
    assert one(text.salvaged_pairs(answer)) == {0: 'Parsing "core"', 1: "Cache layer"}
    keys = [one(F.to_json(text.version_key(lit(v)))) for v in ("v1.2", "1.2.0-rc.1+b", "x.1")]
    assert keys[2] is None and one(text.version_key(lit("1.2.0-rc.1")) < text.version_key(lit("v1.2"))) is True
    assert one(text.version_key(lit("1.10.0")) > text.version_key(lit("1.9.9"))) is True


def test_sizes_of_large_parts_match_sql(spark, tmp_path):
    import duckdb

    from skein.queries import reports

    part = spark.createDataFrame([(k, "blue steel rod") for k in (1, 4, 120, 3000, 121895, 1200000)], "p_partkey long, p_name string")
    part.write.parquet(str(tmp_path / "part.parquet"))
    df = reports.text_numbers(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = db.sql("SELECT " + ", ".join(df.columns) + " FROM (" + reports.ORACLES["text_numbers"] + ")").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
    sizes = spark.createDataFrame([(1280,), (1024**4,)], "n long").select(text.human_size(F.col("n")).alias("s"))
    assert {r.s for r in sizes.collect()} == {"1.2 KB", "1.0 TB"}  # a tie goes to the even digit, as printf has it
