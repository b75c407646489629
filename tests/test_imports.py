from skein.graph import Graph, edges_of, nodes_of
from skein.sources import imports as m

KNOWN = "entity string, label string, source_file string, stem string, folder string"


def resolve(spark, file, label, known):
    imported = spark.createDataFrame([("src", file, label)], "source string, source_file string, label string")
    got = m.resolved(imported, spark.createDataFrame(known, KNOWN))
    return sorted(r.entity for r in got.collect())


def test_labels_of_each_family(spark):
    known = [
        ("helpers.f", "f", "a/helpers.ts", "helpers", None), ("helpers.g", "g", "a/helpers.ts", "helpers", None), ("index.x", "x", "a/index.ts", "index", None),
        ("Config", "Config", "m/model.rs", "model", None), ("Other", "Other", "m/model.rs", "model", None), ("List", "List", "u/List.java", "List", None),
        ("Serve", "Serve", "pkg/http/server.go", "server", "http"), ("vec", "vec_add", "inc/vector.h", "vector", None), ("User", "User", "app/User.php", "User", None),
        ("Widget", "Widget", "lib/widget.dart", "widget", None),
    ]
    cases = {
        ("b.ts", "helpers/f"): ["helpers.f", "helpers.g"], ("b.ts", "./helpers"): ["helpers.f", "helpers.g"], ("b.ts", "helpers/f as z"): ["helpers.f", "helpers.g"],
        ("b.ts", "./unknown"): ["index.x"], ("b.ts", "unknown"): [], ("b.rs", "crate::model::Config"): ["Config"], ("b.rs", "crate::model::*"): ["Config", "Other"],
        ("b.rs", "pub use crate::model::Missing"): ["Config", "Other"], ("B.java", "java.util.List"): ["List"], ("B.java", "static app.model.Other"): ["Other"],
        ("b.go", 'alias "example.com/net/http"'): ["Serve"], ("b.go", "net/http"): ["Serve"], ("b.c", "<inc/vector.h>"): ["vec"], ("b.php", "App\\User"): ["User"],
        ("b.dart", "import 'package:lib/widget.dart' as w"): ["Widget"], ("b.txt", "helpers"): [],
    }
    for (file, label), want in cases.items():
        assert resolve(spark, file, label, known) == want, (file, label)


def graph(spark):
    node = lambda i, label, file, kind="function": {"id": i, "label": label, "source_file": file, "node_type": kind}
    nodes = [
        node("a", "a", "a.py", "file"), node("b", "b", "b.py", "file"), node("a_run", "run", "a.py"), node("b_run", "run", "b.py"), node("b_walk", "walk", "b.py", "class"),
        node("b_star", "b.*", "", "module"), node("t", "t", "t.ts", "file"), node("u", "u", "u.ts", "file"), node("t_go", "go", "t.ts"), node("u_go", "go", "u.ts"),
        node("u_stop", "stop", "u.ts"), node("m_u", "./u", "", "module"),
    ]
    e = lambda s, t, r, f: {"source": s, "target": t, "relation": r, "source_file": f}
    edges = [
        e("a", "a_run", "defines", "a.py"), e("b", "b_run", "defines", "b.py"), e("b", "b_walk", "defines", "b.py"), e("a", "b_star", "imports", "a.py"), e("a", "run", "imports", "a.py"),
        e("t", "t_go", "defines", "t.ts"), e("u", "u_go", "defines", "u.ts"), e("u", "u_stop", "defines", "u.ts"), e("t", "m_u", "imports", "t.ts"),
    ]
    return Graph(nodes_of(spark, nodes), edges_of(spark, edges))


def test_python_and_cross_file_edges(spark):
    g = graph(spark)
    moved, star = m.python_imports(g)
    assert {(r.source, r.target) for r in moved.collect()} == {("a", "b_star"), ("a", "a_run"), ("t", "m_u")}
    assert {(r.source, r.target, r.confidence_score) for r in star.collect()} == {("a", "b_run", 0.7), ("a", "b_walk", 0.7)}
    uses = m.cross_file_uses(g)
    assert {(r.source, r.target, r.confidence_score) for r in uses.collect()} == {("t_go", "u_go", 0.8)}
    assert {(r.source, r.target, r.confidence_score) for r in m.calls_from_uses(g, uses).collect()} == {("t_go", "u_go", 0.5)}
    every = m.linked_graph(g).edges.groupBy("relation").count().collect()
    assert {r.relation: r["count"] for r in every} == {"defines": 6, "imports": 3, "uses": 3, "calls": 1}


def test_markdown_links(spark):
    files = [("docs/a.md", "[x](../src/m.rs) [[guide]] [y](./b) [z](https://e.org/a.md) [w](/top.md#p)\n[r]: a.md"), ("docs/b.md", ""), ("src/m.rs", ""), ("top.md", ""), ("other/guide.md", "")]
    got = m.markdown_links(spark.createDataFrame(files, "path string, content string")).collect()
    assert {(r.source, r.target) for r in got} == {("docs_a_md", t) for t in ("src_m_rs", "other_guide_md", "docs_b_md", "top_md")}
