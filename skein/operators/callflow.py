"""Call-flow documents: sections of a graph, their diagrams, tables and order.

A section is a group of communities.  What has a row per node or edge stays in
DataFrames; what has a row per section (at most ``MOST_SECTIONS`` of them) is put
together on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import is_test_file, mermaid_escape
from skein.graph import Graph
from skein.operators.sections import drawn

#: Relations a diagram prefers; the rest is a fallback.
PREFERRED = ("calls", "uses", "imports", "depends_on", "references")
#: Kinds of section with words that tell them, in order of precedence.
ARCHETYPES = {
    "api": ("api", "route", "handler", "endpoint", "server", "request"),
    "storage": ("store", "cache", "database", "sql", "index", "file"),
    "analysis": ("graph", "cluster", "score", "rank", "analyze", "metric"),
    "parsing": ("parse", "extract", "token", "lexer", "syntax", "reader"),
    "export": ("export", "render", "format", "write", "html", "report"),
    "command": ("cmd", "command", "cli", "main", "option", "config"),
}
LEAST_SCORE = 2
MOST_SECTIONS = 12
MOST_STEPS = 7


def archetype_scores(g: Graph) -> DataFrame:
    """(community, kind, score, place): how often words of a kind occur in labels and files of a community."""
    text = F.lower(F.concat_ws(" ", "label", "source_file"))
    n = g.nodes.where("community is not null").select("community", text.alias("t"))
    kinds = [
        F.struct(F.lit(k).alias("kind"), F.lit(i).alias("place"), sum((F.size(F.regexp_extract_all("t", F.lit(f"({w})"), F.lit(1))) for w in words), F.lit(0)).alias("score"))
        for i, (k, words) in enumerate(ARCHETYPES.items())
    ]
    s = n.select("community", F.explode(F.array(*kinds)).alias("x")).groupBy("community", "x.kind", "x.place").agg(F.sum("x.score").alias("score"))
    return s.select("community", "kind", "score", "place")


def sections(g: Graph, most: int = MOST_SECTIONS) -> DataFrame:
    """(community, section): the kind that scores best and at least ``LEAST_SCORE``, precedence on ties; the smallest beyond ``most`` are ``other``."""
    best = archetype_scores(g).groupBy("community").agg(F.min(F.struct((-F.col("score")).alias("s"), "place", "kind")).alias("b"))
    named = best.select("community", F.when(-F.col("b.s") >= LEAST_SCORE, F.col("b.kind")).alias("kind"))
    size = g.nodes.where("community is not null").groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    loose = size.join(named.where("kind is null"), "community").orderBy(F.desc("n"), "community").limit(most).select("community", F.lit(True).alias("own"))
    return named.join(loose, "community", "left").select(
        "community", F.coalesce("kind", F.when(F.col("own"), F.format_string("section %d", "community")), F.lit("other")).alias("section")
    )


def edge_score(relation: Column, confidence: Column, score: Column) -> Column:
    """A preferred relation weighs its confidence, any other half of it."""
    return F.when(relation.isin(*PREFERRED), score).otherwise(score / 2) * F.when(confidence == "EXTRACTED", 1.0).otherwise(0.8)


def section_nodes(g: Graph, by: DataFrame) -> DataFrame:
    return g.nodes.where("community is not null").join(by, "community").select("id", "label", "source_file", "node_type", "section")


def classified_edges(g: Graph, by: DataFrame) -> DataFrame:
    """(source, target, relation, src, dst, inter, score): drawn edges by the sections of their ends."""
    s = section_nodes(g, by).select("id", "section")
    e = g.edges.where(drawn(F.col("confidence"), F.col("confidence_score")))
    e = e.join(s.select(F.col("id").alias("source"), F.col("section").alias("src")), "source").join(s.select(F.col("id").alias("target"), F.col("section").alias("dst")), "target")
    score = edge_score(F.col("relation"), F.col("confidence"), F.col("confidence_score"))
    return e.select("source", "target", "relation", "src", "dst", (F.col("src") != F.col("dst")).alias("inter"), score.alias("score"))


def participation(edges: DataFrame) -> DataFrame:
    """(id, score): the sum of the scores of a node's edges."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"), "score")
    return ends.groupBy("id").agg(F.sum("score").alias("score"))


def diagram_nodes(g: Graph, by: DataFrame, section: str, most: int = 12) -> list[str]:
    """Up to ``most`` ids: entry points, then ends of the strongest edges, then the best connected; few concepts.

    Three rankings of at most ``most`` rows each come to the driver.
    """
    edges = classified_edges(g, by).where((F.col("src") == section) & (F.col("dst") == section))
    nodes = section_nodes(g, by).where(F.col("section") == section)
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("out"))
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("into"))
    flow = nodes.join(out, "id", "left").join(into, "id", "left").na.fill(0, ["out", "into"])
    wide = 4 * most  # a greedy choice may pass over concepts and repeated ends
    entries = [r.id for r in flow.where("out > 0").orderBy(F.desc(F.col("out") - F.col("into")), F.desc("out"), "id").limit(wide).collect()]
    strong = [i for r in edges.orderBy(F.desc("score"), "source", "target", "relation").limit(wide).collect() for i in (r.source, r.target)]
    rest = [r.id for r in nodes.join(g.degree(), "id").orderBy(F.desc("degree"), "id").limit(wide).collect()]
    order = list(dict.fromkeys([*entries[: max(1, most // 3)], *strong, *rest]))
    concepts = {r.id for r in nodes.where("node_type = 'concept'").join(g.nodes.sparkSession.createDataFrame([(i,) for i in order], "id string"), "id", "left_semi").collect()} if order else set()
    chosen, few = [], 0
    for i in order:
        if len(chosen) == most:
            break
        if i in concepts:
            if few >= max(4, most // 3):
                continue
            few += 1
        chosen.append(i)
    return chosen


def section_pairs(edges: DataFrame) -> DataFrame:
    """(src, dst, n, relation): edges between sections, and their most frequent relation, ties by name."""
    per = edges.where("inter").groupBy("src", "dst", "relation").agg(F.count(F.lit(1)).alias("k"))
    best = F.min(F.struct((-F.col("k")).alias("k"), "relation"))
    return per.groupBy("src", "dst").agg(F.sum("k").alias("n"), best.alias("b")).select("src", "dst", "n", F.col("b.relation").alias("relation"))


def flow_chain(names: list[str], pairs: list[tuple[str, str, int]], most: int = MOST_STEPS) -> list[str]:
    """Sections in reading order: from the one with the fewest edges into it, each time along most edges to one not yet read."""
    if not names:
        return []
    into = {n: sum(k for _, d, k in pairs if d == n) for n in names}
    chain = [min(names, key=lambda n: (into[n], names.index(n)))]
    while len(chain) < min(most, len(names)):
        ways = [(k, d) for s, d, k in pairs if s == chain[-1] and d in into and d not in chain]
        chain.append(max(ways)[1] if ways else next(n for n in names if n not in chain))
    return chain


def call_rows(g: Graph, by: DataFrame, section: str, shown: int = 20) -> DataFrame:
    """(label, source_file, calls, called_by): the table of a section, best connected first."""
    edges = classified_edges(g, by).where(F.col("src") == section)
    label = g.nodes.select("id", "label")
    to = edges.join(label.withColumnRenamed("id", "target"), "target").groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_set("label")).alias("calls"))
    back = classified_edges(g, by).where(F.col("dst") == section).groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("called_by"))
    n = section_nodes(g, by).where(F.col("section") == section).join(to, "id", "left").join(back, "id", "left")
    n = n.select("id", "label", "source_file", F.coalesce("calls", F.array().cast("array<string>")).alias("calls"), F.coalesce("called_by", F.lit(0)).alias("called_by"))
    return n.orderBy(F.desc(F.size("calls") + F.col("called_by")), "id").limit(shown).select("label", "source_file", F.array_join(F.slice("calls", 1, 5), ", ").alias("calls"), "called_by")


def overview_lines(g: Graph, by: DataFrame) -> DataFrame:
    """(part, line): a Mermaid flowchart of sections and the edges between them."""
    size = section_nodes(g, by).groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    key = lambda c: F.concat(F.lit("s_"), F.regexp_replace(c, "[^A-Za-z0-9]", "_"))
    head = size.limit(0).select(F.lit(0).alias("part"), F.lit("").alias("line")).unionAll(g.nodes.sparkSession.createDataFrame([(0, "flowchart LR")], "part int, line string"))
    boxes = size.select(F.lit(1), F.concat(key(F.col("section")), F.lit('["'), mermaid_escape(F.col("section")), F.lit(" ("), F.col("n").cast("string"), F.lit(')"]')))
    links = section_pairs(classified_edges(g, by)).select(
        F.lit(2), F.concat(key(F.col("src")), F.lit(" -->|"), mermaid_escape(F.col("relation")), F.lit(" x"), F.col("n").cast("string"), F.lit("| "), key(F.col("dst")))
    )
    return head.unionAll(boxes).unionAll(links)


def production_words(g: Graph, by: DataFrame) -> DataFrame:
    """Nodes of each section without those in test files, unless a section has no others."""
    n = section_nodes(g, by).withColumn("test", is_test_file(F.col("source_file")))
    real = F.min(F.col("test").cast("int")).over(Window.partitionBy("section"))
    return n.withColumn("any", real).where(~F.col("test") | (F.col("any") == 1)).drop("any")


def report_highlights(lines: list[str], most: int = 5) -> list[list[str]]:
    """The cells of the first table rows of a Markdown report, heads and rules left out."""
    rows = [[c.strip() for c in x.strip().strip("|").split("|")] for x in lines if x.strip().startswith("|")]
    body = [r for i, r in enumerate(rows) if not all(set(c) <= set(":- ") for c in r) and not (i + 1 < len(rows) and all(set(c) <= set(":- ") for c in rows[i + 1]))]
    return body[:most]


def document(g: Graph, title: str = "Call flow") -> str:
    """The whole document as Markdown: overview, reading order, a table for each section of the order."""
    by = sections(g)
    edges = classified_edges(g, by)
    names = [r.section for r in section_nodes(g, by).groupBy("section").count().orderBy(F.desc("count"), "section").limit(MOST_SECTIONS).collect()]
    pairs = [(r.src, r.dst, r.n) for r in section_pairs(edges).collect() if r.src in names and r.dst in names]
    chain = flow_chain(names, pairs)
    out = [f"# {title}", "", "```mermaid", *[r.line for r in overview_lines(g, by).orderBy("part", "line").collect()], "```", "", " -> ".join(chain), ""]
    for name in chain:
        out += [f"## {name}", "", "| name | file | calls | called by |", "|-|-|-|-|"]
        out += [f"| {r.label} | {r.source_file} | {r.calls} | {r.called_by} |" for r in call_rows(g, by, name).collect()] + [""]
    return "\n".join(out)
