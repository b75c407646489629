from pyspark.sql import functions as F

from skein.sources import extract, files


def test_kinds_and_sensitive_files(spark):
    cases = {
        "src/a.py": ("code", False), "docs/a.md": ("document", False), "go.mod": ("code", False), "x/Icon.imageset/a.png": (None, False), "a.png": ("image", False), "b.unknown": (None, False),
        "id_rsa": (None, True), "x/.netrc": (None, True), "home/.ssh/config": (None, True), "my_secret.txt": ("document", True), "secret_resolver.rs": ("code", True),
        "tokenizer.rs": ("code", False), "auth_token.json": ("code", True), "auth_token.ts": ("code", False), "key.pem": (None, True), "private.md": ("document", False),
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string").select("path", files.file_kind(F.col("path"), F.lit("")).alias("k"), files.is_sensitive(F.col("path")).alias("s"))
    assert {r.path: (r.k, r.s) for r in df.collect()} == cases
    paper = spark.createDataFrame([("a.md", "Abstract. We propose a method [12]."), ("b.md", "Abstract. We propose.")], "path string, head string")
    assert [r.k for r in paper.select(files.file_kind(F.col("path"), F.col("head")).alias("k")).collect()] == ["paper", "document"]


def test_quick_scan_reuses_what_did_not_change(spark, tmp_path):
    listing = lambda rows: spark.createDataFrame([(p, m, len(c), c.encode()) for p, m, c in rows], "path string, mtime long, size long, content binary")
    path = str(tmp_path / "index")
    first = files.quick_scan(listing([("a", 1, "one two"), ("b", 1, "three"), ("c", 1, "x")]), files.load_snapshot(spark, path))
    assert {r.status for r in first.collect()} == {"added"}
    files.save_snapshot(first, path)
    known = files.load_snapshot(spark, path)
    second = files.quick_scan(listing([("a", 1, "ONE TWO"), ("b", 2, "three"), ("c", 2, "y")]), known)
    assert {(r.path, r.status, r.words) for r in second.collect()} == {("a", "same", 2), ("b", "same", 1), ("c", "changed", 1)}
    assert files.has_changed(second, known) and not files.has_changed(files.quick_scan(listing([("a", 1, "one two"), ("b", 1, "three"), ("c", 1, "x")]), known), known)


def facts(spark, *sources):
    g = extract.extract(spark.createDataFrame(list(sources), "path string, content string"))
    nodes = {(r.label, r.node_type) for r in g.nodes.where("node_type not in ('file', 'module') or source_file <> ''").collect() if r.node_type != "file"}
    label = {r.id: r.label for r in g.nodes.collect()}
    return nodes, {(label[e.source], e.relation, label.get(e.target)) for e in g.edges.collect()}


def test_statements_and_blocks(spark):
    sql = 'CREATE TABLE IF NOT EXISTS "users" (id int);\ncreate or replace view active as select 1;\nCREATE FUNCTION total() RETURNS int;\nselect 1;\ncreate temporary table t2 (a int);'
    tf = 'resource "aws_bucket" "logs" {\n  name = "x"\n}\nvariable "region" {}\nmodule "net" {\n}'
    nodes, _ = facts(spark, ("a.sql", sql), ("b.tf", tf))
    assert nodes == {("users", "class"), ("active", "interface"), ("total", "function"), ("t2", "class"), ("logs", "class"), ("region", "variable"), ("net", "module")}


def test_more_languages_and_calls(spark):
    nodes, edges = facts(
        spark,
        ("a.ex", "defmodule Shop.Cart do\n  import Enum\n  def total(x) do\n    add(x)\n  end\n  def add(x), do: x\nend"),
        ("b.sh", "build() {\n  echo hi\n}\nall() {\n  build\n}"),
        ("c.pas", "unit Tools;\nuses SysUtils;\nfunction Twice(x: Integer): Integer;\nbegin\nend;\nprocedure Run;\nbegin\n  twice(2);\nend;"),
        ("d.vue", "<template>\n function no() {}\n</template>\n<script>\nfunction yes() {}\n</script>"),
        ("e.zig", 'const std = @import("std");\nconst Point = struct {};\npub fn main() void {}'),
    )
    assert {("Shop.Cart", "module"), ("build", "function"), ("Tools", "module"), ("yes", "function"), ("Point", "struct"), ("main", "function")} <= nodes
    assert ("no", "function") not in nodes
    assert {("all", "calls", "build"), ("Run", "calls", "Twice"), ("total", "calls", "add"), ("e", "imports", "std")} <= edges


def test_docstrings(spark):
    source = '"""What this module is good for."""\n\ndef f(x):\n    """Returns x without any change at all."""\n    return x\n\nclass C:\n    \'\'\'short\'\'\'\n    y = """not a docstring, but a long text"""\n'
    got = extract.docstrings(spark.createDataFrame([("a.py", source), ("b.py", "# generated by a tool\n" + source)], "path string, content string")).collect()
    assert {(r.path, r.at, r.owner, r.text) for r in got} == {("a.py", 1, "", "What this module is good for."), ("a.py", 4, "f", "Returns x without any change at all.")}
