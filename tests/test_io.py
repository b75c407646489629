import json

from pyspark.sql import functions as F

from skein.graph import Graph, edges_of, nodes_of
from skein.sinks import formats
from skein.sources import extract, files
from skein.streaming import watch

PY = """import os
from app.models import User

class Service:
    def get(self, x):
        return helper(x)

def helper(y):
    # NOTE: kept simple on purpose
    return os.path.join(y)
"""
GO = 'package main\n\nimport "fmt"\n\ntype Server struct {\n}\n\nfunc (s *Server) Run() {\n\tstart()\n}\n\nfunc start() {\n\tfmt.Println("x")\n}\n'


def sources(spark):
    rows = [("app/service.py", PY), ("app/models.py", "class User:\n    pass\n"), ("main.go", GO), ("schema.sql", "CREATE TABLE users (id int);\nCREATE VIEW active AS SELECT 1;\n"), ("x.unknown", "class No")]
    return spark.createDataFrame(rows, "path string, content string")


def test_extraction(spark):
    g = extract.extract(sources(spark))
    kinds = {(r.label, r.node_type) for r in g.nodes.collect()}
    assert {("Service", "class"), ("get", "method"), ("helper", "function"), ("User", "class"), ("Server", "struct"), ("start", "function"), ("users", "class"), ("active", "interface"), ("service", "file"), ("os", "module")} <= kinds
    label = {r.id: r.label for r in g.nodes.collect()}
    edges = {(label[e.source], e.relation, label[e.target]) for e in g.edges.collect()}
    assert {("Service", "defines", "get"), ("service", "defines", "helper"), ("service", "imports", "os"), ("get", "calls", "helper"), ("Run", "calls", "start")} <= edges
    uses = {(label[e.source], label[e.target]) for e in extract.resolve_imports(g).collect()}
    assert ("service", "User") in uses
    assert [(r.at, r.label) for r in extract.rationale_nodes(sources(spark)).collect()] == [(9, "NOTE: kept simple on purpose")]


def test_scan_and_rescan(spark, tmp_path):
    for name, body in (("src/a.py", "x = 1\n"), ("notes.md", "hello wide world"), ("node_modules/b.js", "x"), (".env", "KEY=1"), ("my_secret.txt", "x"), ("paper.md", "Abstract. We propose a method, see the literature and doi 1.")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    got = {r.path: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"src/a.py", "notes.md", "paper.md"}
    assert (got["notes.md"].words, got["src/a.py"].file_type, got["paper.md"].file_type) == (3, "code", "paper")
    cols = "path string, mtime long, size long, hash string"
    old = spark.createDataFrame([("same", 1, 1, "h"), ("touched", 1, 1, "h"), ("edited", 1, 1, "h"), ("gone", 1, 1, "h")], cols)
    new = spark.createDataFrame([("same", 1, 1, "x"), ("touched", 2, 1, "h"), ("edited", 2, 1, "z"), ("fresh", 1, 1, "h")], cols)
    assert {r.path: r.status for r in files.rescan(new, old).collect()} == {"same": "same", "touched": "same", "edited": "changed", "gone": "removed", "fresh": "added"}


def small(spark):
    nodes = [{"id": i, "label": lab, "source_file": "./a.rs", "node_type": "class", "community": c} for i, lab, c in (("a-1", "A & b", 0), ("a.1", "it's", 0), ("c", "C", 1))]
    return Graph(nodes_of(spark, nodes), edges_of(spark, [{"source": "a-1", "target": "c", "relation": "imports"}, {"source": "a-1", "target": "c", "relation": "imports"}]))


def test_node_link_round_trip(spark, tmp_path):
    g = small(spark)
    doc = json.loads(formats.node_link_document(g, compatible=True))
    assert doc["links"][0]["relation"] == "imports_from" and doc["nodes"][0]["source_file"] == "a.rs"
    doc["nodes"].append({"id": "c", "label": "again"})
    doc["links"].append({"source": "c", "target": "missing", "relation": "x"})
    doc["hyperedges"] = [{"nodes": ["a-1", "c"], "relation": "r", "label": "l"}]
    (tmp_path / "g.json").write_text(json.dumps(doc))
    back = files.read_node_link(spark, str(tmp_path / "g.json"))
    assert back.nodes.count() == 3 and back.edges.count() == 2 and back.hyperedges.count() == 1
    assert back.nodes.where("id = 'c'").first().label == "C"


def test_text_formats(spark, tmp_path):
    g = small(spark)
    lines = [r.line for r in formats.cypher(g).collect()]
    assert any("a_1_0:Class {id: 'a-1'}" in x for x in lines) and any("\\'s'" in x for x in lines) and any("-[:IMPORTS]->" in x for x in lines)
    assert any("A &amp; b" in r.line for r in formats.graphml(g).collect())
    triples = [r.line for r in formats.turtle(g).collect()]
    assert len(triples) == 4 and any("<urn:graph:a-1>" in x for x in triples)
    formats.write_text(formats.graphml(g), str(tmp_path / "out"), *formats.GRAPHML_FRAME)
    assert spark.read.text(str(tmp_path / "out")).where(F.col("value").startswith("<node")).count() == 3
    assert formats.prune_for_display(g, 2).count() == 2 and formats.prune_for_display(g, 0).count() == 3
    assert {r.name for r in formats.wiki_pages(g).collect()} == {"community_0", "community_1"}
    assert formats.notes(g).count() == 3 and formats.tree_rows(g, 1).where("kind = 'overflow'").count() == 1
    assert {(round(r.x), round(r.y)) for r in formats.svg_layout(g.nodes.select("id")).collect()} >= {(600, 60)}
    assert formats.vis_nodes(g).where("id = 'c'").first().size == 40


def test_memory_docs(spark):
    d = spark.createDataFrame([("m.md", '---\ntype: query\ntimestamp: 2024-01-01T00:00:00Z\nquestion: "why?"\nnodes: ["a", "b", "a"]\noutcome: good\n---\nbody')], "path string, text string")
    r = files.memory_docs(d).first()
    assert (r.question, r.outcome, r.correction, r.nodes) == ("why?", "good", None, ["a", "b"]) and r.ts.year == 2024


def test_watch_and_upsert(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("def f():\n    return g()\n\ndef g():\n    pass\n")
    seen = []

    def rebuild(batch, n):
        seen.append(extract.extract(batch.withColumn("path", F.element_at(F.split("path", "/"), -1))).nodes.count())

    q = watch.watch_files(spark, str(tmp_path / "in"), rebuild, str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert seen == [3]
    old = extract.extract(spark.createDataFrame([("a.py", "def f():\n  pass\ndef g():\n  pass\n"), ("b.py", "def h():\n  pass\n")], "path string, content string"))
    new = extract.extract(spark.createDataFrame([("a.py", "def f():\n  pass\ndef k():\n  pass\n")], "path string, content string"))
    assert {r.label for r in watch.upsert(old, new).nodes.collect()} == {"a", "f", "k", "b", "h"}
