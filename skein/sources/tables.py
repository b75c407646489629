"""Facts that arrive as rows: database catalogs, code graphs, commit logs, pull requests, model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import make_id, normalize_path, quote_identifier
from skein.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph, complete
from skein.operators.build import first_wins

#: What kinds of symbols and relations of a code graph are here.
CODE_KINDS = {"function": "function", "method": "method", "class": "class", "struct": "struct", "interface": "interface", "enum": "enum", "trait": "trait", "module": "module", "file": "file", "variable": "variable", "constant": "constant"}
CODE_RELATIONS = {"calls": "calls", "imports": "imports", "contains": "defines", "extends": "extends", "implements": "implements", "references": "uses"}


def _mapped(column, table: dict[str, str]):
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(column))


def catalog_graph(relations: DataFrame, routines: DataFrame, foreign_keys: DataFrame) -> Graph:
    """A graph from catalog rows: ``relations`` (schema, name, kind: table or view), ``routines`` (schema, name),
    ``foreign_keys`` (schema, name, to_schema, to_name, columns, to_columns)."""
    place = F.concat_ws(".", quote_identifier(F.col("schema")), quote_identifier(F.col("name")))
    node = lambda df, kind: df.select(make_id(F.col("schema"), F.col("name")).alias("id"), place.alias("label"), kind.alias("node_type"), F.concat(F.lit("catalog/"), F.col("schema")).alias("source_file"))
    nodes = node(relations, F.when(F.col("kind") == "view", "interface").otherwise("class")).unionAll(node(routines, F.lit("function")))
    nodes = first_wins(complete(nodes, NODE_SCHEMA), ["id"], ["node_type", "label"])
    context = F.to_json(F.struct(F.lit("foreign_key").alias("context"), F.array_join("columns", ",").alias("columns"), F.array_join("to_columns", ",").alias("to_columns")))
    keys = foreign_keys.select(
        make_id(F.col("schema"), F.col("name")).alias("source"), make_id(F.col("to_schema"), F.col("to_name")).alias("target"), F.lit("references").alias("relation"),
        F.concat(F.lit("catalog/"), F.col("schema")).alias("source_file"), context.alias("extra"),
    )
    ids = nodes.select("id")
    keys = keys.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return Graph(nodes, complete(keys, EDGE_SCHEMA))


def merge_code_graph(g: Graph, symbols: DataFrame, links: DataFrame) -> tuple[Graph, DataFrame]:
    """Add the links of a foreign code graph: ``symbols`` (key, path, name, kind), ``links`` (source, target, kind).

    A symbol is the first node, by id, with its path, name and kind; links between
    matched symbols that the graph lacks are added.  Returns the graph and (matched, added, unmatched), one row.
    """
    s = symbols.select("key", normalize_path(F.col("path")).alias("p"), F.lower("name").alias("n"), _mapped(F.col("kind"), CODE_KINDS).alias("k"))
    own = g.nodes.select("id", normalize_path(F.col("source_file")).alias("p"), F.lower("label").alias("n"), F.col("node_type").alias("k"))
    at = s.join(own, ["p", "n", "k"], "left").groupBy("key").agg(F.min("id").alias("id"))
    known = at.where("id is not null")
    e = links.select("source", "target", _mapped(F.col("kind"), CODE_RELATIONS).alias("relation")).where("relation is not null")
    for end in ("source", "target"):
        e = e.join(known.select(F.col("key").alias(end), F.col("id").alias(f"_{end}")), end).drop(end).withColumnRenamed(f"_{end}", end)
    new = e.where("source <> target").distinct().join(g.edges.select("source", "target", "relation"), ["source", "target", "relation"], "left_anti")
    new = complete(new.withColumn("provenance", F.lit("code-graph")), EDGE_SCHEMA)
    counts = at.agg(F.count("id").alias("matched"), F.count_if(F.col("id").isNull()).alias("unmatched")).crossJoin(new.agg(F.count(F.lit(1)).alias("added")))  # one row each
    return Graph(g.nodes, g.edges.unionByName(new.select(*g.edges.columns)), g.hyperedges), counts


def commits(log: DataFrame) -> DataFrame:
    """(file, ts) from rows (file, output) of ``git log --format=%aI``: a time for each line that is one."""
    line = F.explode(F.split("output", "\n"))
    return log.select("file", line.alias("line")).select("file", F.try_to_timestamp(F.btrim("line")).alias("ts")).where("ts is not null")


def pull_requests(text: DataFrame) -> DataFrame:
    """(number, title, author, draft, review, base, updated, ci, files) from rows (json) holding a list of pull requests.

    The checks of a request are rolled up: any failed, else any unfinished, else passed; none if it has none.
    """
    schema = (
        "array<struct<number:int,title:string,author:struct<login:string>,isDraft:boolean,reviewDecision:string,baseRefName:string,updatedAt:string,"
        "statusCheckRollup:array<struct<conclusion:string,status:string,state:string>>,files:array<struct<path:string>>>>"
    )
    r = text.select(F.explode(F.from_json("json", schema)).alias("r")).select("r.*")
    outcome = lambda c: F.upper(F.coalesce(F.nullif(c["conclusion"], F.lit("")), F.nullif(c["state"], F.lit("")), c["status"], F.lit("PENDING")))
    states = F.transform("statusCheckRollup", outcome)
    bad = F.exists(states, lambda s: s.isin("FAILURE", "ERROR", "TIMED_OUT", "CANCELLED", "ACTION_REQUIRED"))
    going = F.exists(states, lambda s: s.isin("PENDING", "QUEUED", "IN_PROGRESS", "EXPECTED", "WAITING", "REQUESTED"))
    ci = F.when(F.coalesce(F.size("statusCheckRollup"), F.lit(0)) <= 0, "NONE").when(bad, "FAILURE").when(going, "PENDING").otherwise("SUCCESS")
    return r.select(
        "number", "title", F.col("author.login").alias("author"), F.coalesce("isDraft", F.lit(False)).alias("draft"), F.col("reviewDecision").alias("review"), F.col("baseRefName").alias("base"),
        F.try_to_timestamp("updatedAt").alias("updated"), ci.alias("ci"), F.coalesce(F.transform("files", lambda f: f["path"]), F.array().cast("array<string>")).alias("files"),
    )


def concepts(answers: DataFrame) -> Graph:
    """Concept nodes and inferred edges from rows (path, answer) of model output; prose and fences around the JSON do not matter."""
    schema = "struct<nodes:array<struct<id:string,label:string,type:string>>,edges:array<struct<source:string,target:string,relation:string,confidence_score:double>>>"
    body = F.regexp_extract("answer", r"(?s)(\{.*\})", 1)
    a = answers.select("path", F.from_json(body, schema).alias("j"))
    own = lambda c: make_id(F.col("path"), c)
    n = a.select("path", F.explode("j.nodes").alias("n")).where("n.id is not null")
    nodes = n.select(own(F.col("n.id")).alias("id"), F.coalesce("n.label", "n.id").alias("label"), F.lit("concept").alias("node_type"), F.col("path").alias("source_file"))
    e = a.select("path", F.explode("j.edges").alias("e")).where("e.source is not null and e.target is not null")
    edges = e.select(
        own(F.col("e.source")).alias("source"), own(F.col("e.target")).alias("target"), F.coalesce("e.relation", F.lit("relates_to")).alias("relation"), F.lit("INFERRED").alias("confidence"),
        F.least(F.greatest(F.coalesce("e.confidence_score", F.lit(0.7)), F.lit(0.0)), F.lit(1.0)).alias("confidence_score"), F.col("path").alias("source_file"),
    )
    nodes = first_wins(complete(nodes, NODE_SCHEMA), ["id"], ["label"])
    ids = nodes.select("id")
    edges = complete(edges, EDGE_SCHEMA).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return Graph(nodes, edges.select(*[f.name for f in EDGE_SCHEMA.fields]))
