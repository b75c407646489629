"""Package manifests, tool-server configurations and symbol indexes as graphs."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import glob_regex, make_id
from skein.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph, complete
from skein.operators.build import first_wins

_NAME = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)")
_POM_DEP = re.compile(r"<dependency>.*?<artifactId>\s*([^<\s]+)\s*</artifactId>.*?</dependency>", re.S)


def _toml(text: str, path: str) -> tuple[str | None, list[str]]:
    d = tomllib.loads(text)
    if path.endswith("Cargo.toml"):
        found = [k for part in ("dependencies", "dev-dependencies", "build-dependencies") for k in d.get(part, {})]
        return d.get("package", {}).get("name"), found
    p = d.get("project", {})
    listed = [*p.get("dependencies", []), *[x for own in p.get("optional-dependencies", {}).values() for x in own]]
    return p.get("name"), [m[1] for x in listed if (m := _NAME.match(x))]


def parse_manifest(path: str, text: str) -> tuple[str | None, list[str]]:
    """(package, dependencies) of a manifest; (None, []) if it can't be read."""
    name = path.rsplit("/", 1)[-1]
    try:
        if name in ("pyproject.toml", "Cargo.toml"):
            return _toml(text, path)
        if name == "package.json":
            d = json.loads(text)
            return d.get("name"), [k for part in ("dependencies", "devDependencies", "peerDependencies") for k in d.get(part, {})]
        if name == "go.mod":
            own = re.search(r"(?m)^module\s+(\S+)", text)
            block = " ".join(re.findall(r"(?s)require\s*\((.*?)\)", text))
            return own and own[1], re.findall(r"([\w./-]+)\s+v\S+", block) + re.findall(r"(?m)^require\s+([\w./-]+)\s+v", text)
        if name == "pom.xml":
            own = re.search(r"<artifactId>\s*([^<\s]+)", re.sub(r"(?s)<(parent|dependencies|build|dependencyManagement)>.*?</\1>", "", text))
            return own and own[1], _POM_DEP.findall(text)
    except (ValueError, AttributeError, TypeError):
        pass
    return None, []


def workspace_members(files: DataFrame) -> DataFrame:
    """(workspace, path, crate): the Cargo manifests that a workspace's member globs name, less its excluded ones; (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["content"]):
                try:
                    d = tomllib.loads(text)
                except ValueError:
                    continue
                root = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
                w = d.get("workspace", {})
                for kind in ("members", "exclude"):
                    rows += [(path, None, kind, glob_regex(root + m.strip("/") + "/Cargo.toml")) for m in w.get(kind, []) if isinstance(m, str)]
                if d.get("package", {}).get("name"):
                    rows.append((path, d["package"]["name"], "crate", None))
            yield pd.DataFrame(rows, columns=["path", "crate", "kind", "pattern"])

    own = files.where(F.col("path").rlike(r"(^|/)Cargo\.toml$")).select("path", F.col("content").cast("string").alias("content"))
    found = own.mapInPandas(run, "path string, crate string, kind string, pattern string")
    crates = found.where("kind = 'crate'").select("path", "crate")
    named = lambda k: found.where(F.col("kind") == k).select(F.col("path").alias("workspace"), "pattern")
    # A workspace has a handful of globs: every crate meets each of them.
    hit = crates.join(named("members"), F.expr("path rlike pattern")).select("workspace", "path", "crate").distinct()
    return hit.join(named("exclude").withColumnRenamed("workspace", "of"), (F.col("workspace") == F.col("of")) & F.expr("path rlike pattern"), "left_anti")


def manifests(files: DataFrame) -> Graph:
    """Package nodes and ``depends_on`` edges from (path, content); repeated dependencies once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *parse_manifest(p, c)) for p, c in zip(b["path"], b["content"])]
            yield pd.DataFrame([(p, n, d) for p, n, d in rows if n], columns=["path", "name", "deps"])

    names = ("pyproject.toml", "Cargo.toml", "package.json", "go.mod", "pom.xml")
    f = files.where(F.element_at(F.split("path", "/"), -1).isin(*names)).select("path", F.col("content").cast("string").alias("content"))
    p = f.mapInPandas(run, "path string, name string, deps array<string>")
    pkg = lambda c: F.concat(F.lit("pkg_"), make_id(c))
    nodes = p.select(pkg(F.col("name")).alias("id"), F.col("name").alias("label"), F.col("path").alias("source_file"), F.lit("package").alias("node_type"), F.lit(0).cast("long").alias("_ord"))
    edges = p.select("path", "name", F.explode(F.array_distinct("deps")).alias("dep")).select(
        pkg(F.col("name")).alias("source"), pkg(F.col("dep")).alias("target"), F.lit("depends_on").alias("relation"), F.col("path").alias("source_file")
    )
    return Graph(first_wins(complete(nodes, NODE_SCHEMA), ["id"], ["_ord", "source_file"]), complete(edges, EDGE_SCHEMA).dropDuplicates(["source", "target"]))


def tool_servers(files: DataFrame) -> Graph:
    """Servers of tool-server configurations with their command, package and names (never values) of variables."""
    server = "struct<command:string,args:array<string>,env:map<string,string>>"
    d = files.select("path", F.from_json(F.col("content").cast("string"), f"mcpServers map<string,{server}>, servers map<string,{server}>").alias("d"))
    s = d.select("path", F.explode(F.coalesce("d.mcpServers", "d.servers")).alias("name", "s"))
    sid = make_id(F.col("path"), F.col("name"))
    package = F.element_at(F.filter("s.args", lambda a: ~a.startswith("-")), 1)
    clean = F.regexp_replace(package, "(?<=.)@[^@/]+$", "")
    base = s.select(sid.alias("sid"), "path", "name", F.col("s.command").alias("command"), clean.alias("package"), F.map_keys("s.env").alias("env"))

    def part(kind, value, relation, rows=base):
        r = rows.select("sid", "path", value.alias("value")).where("value is not null")
        i = make_id(F.lit(kind), F.col("value"))
        return (
            r.select(i.alias("id"), F.col("value").alias("label"), F.lit("").alias("source_file"), F.lit(kind).alias("node_type")),
            r.select(F.col("sid").alias("source"), i.alias("target"), F.lit(relation).alias("relation"), F.col("path").alias("source_file")),
        )

    parts = [part("function", F.col("command"), "references"), part("package", F.col("package"), "references"), part("variable", F.explode_outer("env"), "requires_env")]
    nodes = base.select(F.col("sid").alias("id"), F.col("name").alias("label"), F.col("path").alias("source_file"), F.lit("module").alias("node_type"))
    edges = None
    for n, e in parts:
        nodes = nodes.unionAll(n)
        edges = e if edges is None else edges.unionAll(e)
    nodes = first_wins(complete(nodes, NODE_SCHEMA), ["id"], ["source_file", "label"])
    return Graph(nodes, complete(edges, EDGE_SCHEMA).dropDuplicates(["source", "target", "relation"]))


def symbol_index(files: DataFrame) -> Graph:
    """A JSON symbol index: (documents: relative_path, symbols: symbol, relationships).

    A relationship leads to the symbol of its own document, else to the only one
    of that name in the index, else to a stub.
    """
    rel = "struct<symbol:string,is_implementation:boolean,is_type_definition:boolean,is_definition:boolean,is_reference:boolean>"
    doc = f"struct<relative_path:string,symbols:array<struct<symbol:string,relationships:array<{rel}>>>>"
    d = files.select(F.explode(F.from_json(F.col("content").cast("string"), f"documents array<{doc}>").getField("documents")).alias("d"))
    s = d.select(F.col("d.relative_path").alias("path"), F.explode("d.symbols").alias("s")).select("path", "s.symbol", "s.relationships").where("symbol is not null")
    label = F.regexp_replace(F.regexp_extract("symbol", r"([^/#.\s`]+)[`().#:]*$", 1), "`", "")
    s = s.withColumn("id", make_id(F.col("path"), F.col("symbol"))).withColumn("label", F.when(label != "", label).otherwise(F.col("symbol")))
    nodes = s.select("id", "label", F.col("path").alias("source_file"), F.lit("class").alias("node_type"))
    kind = (
        F.when(F.col("r.is_implementation"), "scip_impl").when(F.col("r.is_type_definition"), "scip_typed").when(F.col("r.is_definition"), "scip_def").otherwise("scip_ref")
    )
    r = s.select("id", "path", F.explode("relationships").alias("r")).select(F.col("id").alias("source"), "path", F.col("r.symbol").alias("want"), kind.alias("relation"))
    here = s.select("path", F.col("symbol").alias("want"), F.col("id").alias("local")).dropDuplicates(["path", "want"])
    only = s.groupBy(F.col("symbol").alias("want")).agg(F.min("id").alias("lone"), F.count_distinct("id").alias("n")).where("n = 1").select("want", "lone")
    e = r.join(here, ["path", "want"], "left").join(only, "want", "left").withColumn("stub", make_id(F.lit("external"), F.col("want")))
    e = e.select("source", F.coalesce("local", "lone", "stub").alias("target"), "relation", F.col("path").alias("source_file"), "want", F.coalesce("local", "lone").isNull().alias("outside"))
    stubs = e.where("outside").select(F.col("target").alias("id"), F.col("want").alias("label"), F.lit("").alias("source_file"), F.lit("class").alias("node_type"))
    return Graph(first_wins(complete(nodes.unionAll(stubs), NODE_SCHEMA), ["id"], ["source_file", "label"]), complete(e, EDGE_SCHEMA).dropDuplicates(["source", "target", "relation"]))
