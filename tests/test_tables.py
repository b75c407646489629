import json

from skein.graph import Graph, edges_of, nodes_of
from skein.operators import embed
from skein.sources import tables as t


def test_catalog_rows(spark):
    rel = spark.createDataFrame([("public", "users", "table"), ("public", "Active", "view")], "schema string, name string, kind string")
    fn = spark.createDataFrame([("public", "total")], "schema string, name string")
    fk = spark.createDataFrame([("public", "Active", "public", "users", ["uid"], ["id"]), ("public", "users", "public", "gone", ["a"], ["b"])], "schema string, name string, to_schema string, to_name string, columns array<string>, to_columns array<string>")
    g = t.catalog_graph(rel, fn, fk)
    assert {(r.label, r.node_type) for r in g.nodes.collect()} == {("public.users", "class"), ('public."Active"', "interface"), ("public.total", "function")}
    assert [(r.source, r.target, json.loads(r.extra)["context"]) for r in g.edges.collect()] == [("public_active", "public_users", "foreign_key")]


def test_code_graph(spark):
    nodes = nodes_of(spark, [{"id": i, "label": n, "source_file": f, "node_type": "function"} for i, n, f in (("a", "run", "src/a.py"), ("b", "stop", "src/b.py"))])
    g = Graph(nodes, edges_of(spark, [{"source": "a", "target": "b", "relation": "imports"}]))
    symbols = spark.createDataFrame([(1, "./src/a.py", "run", "Function"), (2, "src/x/../b.py", "stop", "function"), (3, "src/c.py", "no", "class")], "key int, path string, name string, kind string")
    links = spark.createDataFrame([(1, 2, "calls"), (1, 2, "imports"), (1, 3, "calls"), (2, 1, "likes")], "source int, target int, kind string")
    out, counts = t.merge_code_graph(g, symbols, links)
    assert {(r.source, r.target, r.relation) for r in out.edges.collect()} == {("a", "b", "imports"), ("a", "b", "calls")}
    assert counts.first().asDict() == {"matched": 2, "unmatched": 1, "added": 1}


def test_logs_requests_and_answers(spark):
    log = spark.createDataFrame([("a.py", "2024-01-02T03:04:05+00:00\nnoise\n2024-02-01T00:00:00+00:00\n")], "file string, output string")
    assert t.commits(log).count() == 2
    prs = [{"number": 3, "title": "x", "author": {"login": "u"}, "isDraft": False, "reviewDecision": "APPROVED", "baseRefName": "main", "updatedAt": "2024-01-01T00:00:00Z", "statusCheckRollup": [{"conclusion": "SUCCESS"}, {"state": "FAILURE"}], "files": [{"path": "a.py"}]}, {"number": 4, "statusCheckRollup": [{"status": "IN_PROGRESS", "conclusion": ""}]}, {"number": 5}]
    got = {r.number: r for r in t.pull_requests(spark.createDataFrame([(json.dumps(prs),)], "json string")).collect()}
    assert [(got[i].ci, got[i].files) for i in (3, 4, 5)] == [("FAILURE", ["a.py"]), ("PENDING", []), ("NONE", [])]
    answer = 'Here:\n```json\n{"nodes": [{"id": "Idea", "label": "An idea"}, {"id": "b"}], "edges": [{"source": "Idea", "target": "b", "confidence_score": 7}, {"source": "Idea", "target": "gone"}]}\n```'
    g = t.concepts(spark.createDataFrame([("d.md", answer), ("e.md", "no json")], "path string, answer string"))
    assert {r.label for r in g.nodes.collect()} == {"An idea", "b"}
    assert [(r.source, r.target, r.confidence, r.confidence_score) for r in g.edges.collect()] == [("d_md_idea", "d_md_b", "INFERRED", 1.0)]


def test_nodes_with_the_same_neighbours_are_alike(spark):
    pairs = [(x, h) for x in "abc" for h in ("h1", "h2")] + [(x, h) for x in "xyz" for h in ("k1", "k2")]
    g = Graph(nodes_of(spark, [{"id": i} for i in [*"abcxyz", "h1", "h2", "k1", "k2", "lone"]]), edges_of(spark, [{"source": a, "target": b, "relation": "calls"} for a, b in pairs]))
    got = embed.find_similar(g, 20, 0.9, dim=32, window=3).collect()
    assert {("a", "b"), ("a", "c"), ("b", "c"), ("x", "y"), ("x", "z"), ("y", "z")} <= {(r.a, r.b) for r in got}
    assert all((r.a in "abch1h2") == (r.b in "abch1h2") for r in got)


def test_office_files(spark):
    import io
    import zipfile

    from skein.sources import office

    def packed(**members):
        f = io.BytesIO()
        with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in members.items():
                z.writestr(name.replace("__", "/") + ".xml", text)
        return f.getvalue()

    w = 'xmlns:w="urn:w"'
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    doc = packed(word__document=f"<w:document {w}><w:body>{p('Title', 'Heading1')}<w:tbl><w:tr><w:tc>{p('a|b')}</w:tc><w:tc>{p('c')}</w:tc></w:tr></w:tbl>{p('End')}</w:body></w:document>")
    book = packed(
        xl__workbook='<workbook><sheets><sheet name="Sums"/></sheets></workbook>', xl__sharedStrings="<sst><si><t>name</t></si></sst>",
        xl__worksheets__sheet1='<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row></sheetData></worksheet>',
    )
    bomb = packed(word__document="<w:document>" + " " * 40_000_000 + "</w:document>")
    df = spark.createDataFrame([("a.docx", doc), ("b.xlsx", book), ("c.docx", bomb), ("d.docx", b"none"), ("e.md", b"x")], "path string, content binary")
    got = {r.path: r for r in office.office_text(df).collect()}
    assert got["a.docx"].text == "# Title\n\nEnd\n\n| a\\|b | c |\n\n|-|-|" and got["b.xlsx"].text == "## Sums\n\n| name |  | 7 |\n|-|-|-|"
    assert "inflates" in got["c.docx"].error and got["d.docx"].text is None and "e.md" not in got


def test_workspaces_and_memory_documents(spark):
    from pyspark.sql import functions as F

    from skein.sinks import formats
    from skein.sources import manifests

    rows = [("w/Cargo.toml", '[workspace]\nmembers = ["crates/*", "tools/x"]\nexclude = ["crates/old"]'), ("w/crates/a/Cargo.toml", '[package]\nname = "a"'), ("w/crates/old/Cargo.toml", '[package]\nname = "old"'), ("w/tools/x/Cargo.toml", '[package]\nname = "x"'), ("w/tools/y/Cargo.toml", '[package]\nname = "y"')]
    got = manifests.workspace_members(spark.createDataFrame(rows, "path string, content string")).collect()
    assert {(r.workspace, r.crate) for r in got} == {("w/Cargo.toml", "a"), ("w/Cargo.toml", "x")}
    r = spark.createDataFrame([("query", 'why "x"?', "because", ["a", "b"], "2024-01-02 03:04:05")], "type string, question string, answer string, nodes array<string>, at string")
    m = formats.memory_documents(r.withColumn("at", F.to_timestamp("at"))).first()
    assert m.name.startswith("query_20240102T030405_") and 'question: "why \\"x\\"?"' in m.text and m.text.endswith("because\n")
