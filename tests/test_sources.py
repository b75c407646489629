import json

from skein.graph import Graph, edges_of, nodes_of
from skein.operators import sections
from skein.sources import manifests as m


def test_manifests(spark):
    rows = [
        ("a/pyproject.toml", '[project]\nname = "app"\ndependencies = ["numpy>=1", "pandas[x]", "numpy"]\n[project.optional-dependencies]\ndev = ["pytest"]\n'),
        ("b/go.mod", "module example.com/b\n\nrequire (\n\tgithub.com/x/y v1.2.3\n)\nrequire github.com/z/w v0.1.0\n"),
        ("c/pom.xml", "<project><artifactId>svc</artifactId><dependencies><dependency><groupId>g</groupId><artifactId>core</artifactId></dependency></dependencies></project>"),
        ("d/package.json", "not json"),
        ("e/Cargo.toml", '[package]\nname = "tool"\n[dependencies]\napp = "1"\n'),
    ]
    g = m.manifests(spark.createDataFrame(rows, "path string, content string"))
    assert {r.label for r in g.nodes.collect()} == {"app", "example.com/b", "svc", "tool"}
    assert {(e.source, e.target) for e in g.edges.collect()} == {
        ("pkg_app", "pkg_numpy"), ("pkg_app", "pkg_pandas"), ("pkg_app", "pkg_pytest"), ("pkg_example_com_b", "pkg_github_com_x_y"),
        ("pkg_example_com_b", "pkg_github_com_z_w"), ("pkg_svc", "pkg_core"), ("pkg_tool", "pkg_app"),
    }


def test_tool_servers_keep_names_only(spark):
    config = json.dumps({"mcpServers": {"files": {"command": "npx", "args": ["-y", "@scope/server@1.2"], "env": {"API_KEY": "hunter2"}}}})
    g = m.tool_servers(spark.createDataFrame([(".mcp.json", config)], "path string, content string"))
    assert {(r.label, r.node_type) for r in g.nodes.collect()} == {("files", "module"), ("npx", "function"), ("@scope/server", "package"), ("API_KEY", "variable")}
    assert {e.relation for e in g.edges.collect()} == {"references", "requires_env"}
    assert "hunter2" not in str(g.nodes.collect()) + str(g.edges.collect())


def test_symbol_index(spark):
    rel = lambda s, **k: {"symbol": s, **k}
    index = {"documents": [
        {"relative_path": "a.rs", "symbols": [{"symbol": "a/Dog#", "relationships": [rel("b/Animal#", is_implementation=True), rel("x/Gone#", is_reference=True)]}, {"symbol": "shared#"}]},
        {"relative_path": "b.rs", "symbols": [{"symbol": "b/Animal#"}, {"symbol": "shared#", "relationships": [rel("shared#", is_definition=True)]}]},
    ]}
    g = m.symbol_index(spark.createDataFrame([("i.json", json.dumps(index))], "path string, content string"))
    got = {(e.source, e.relation, e.target) for e in g.edges.collect()}
    assert got == {("a_rs_a_dog", "scip_impl", "b_rs_b_animal"), ("a_rs_a_dog", "scip_ref", "external_x_gone"), ("b_rs_shared", "scip_def", "b_rs_shared")}
    assert g.nodes.count() == 5


def test_sections(spark):
    nodes = nodes_of(spark, [{"id": i, "label": lab, "source_file": "x.rs", "node_type": "class", "community": c} for i, lab, c in (("a", "UserService", 0), ("b", "UserStore", 0), ("c", "Cache", 1), ("d", "cache", 1))])
    edges = edges_of(spark, [{"source": "a", "target": "c", "relation": r, "confidence": k} for r, k in (("calls", "EXTRACTED"), ("uses", "EXTRACTED"), ("calls", "EXTRACTED"), ("uses", "AMBIGUOUS"))])
    g = Graph(nodes, edges)
    assert [tuple(r) for r in sections.section_edges(g).collect()] == [(0, 1, 3, "calls")]
    assert [(r.community, r.keyword, r.n) for r in sections.section_keywords(g, 1).orderBy("community").collect()] == [(0, "user", 2), (1, "cache", 2)]
    assert [(r.community, r.size, r.labels) for r in sections.summaries(g).collect()] == [(0, 2, ["UserService", "UserStore"]), (1, 2, ["Cache"])]
    r = sections.token_reduction(g, "where is the user", 1000).first()
    assert (r.corpus_tokens, r.query_tokens) == (1300, 8)
