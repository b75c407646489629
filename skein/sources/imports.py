"""Imports resolved to the entities they mean, across files.

An import is a label.  Each language turns it into an ordered list of candidate
stems (or package folders); the candidates are joined to the entities of the
corpus by one equi join and the first that has any wins.  No index is built on
the driver and no pair of files is tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import file_stem, link_targets, make_id, normalize_path
from skein.graph import EDGE_SCHEMA, Graph, complete
from skein.sources.files import extension

#: Scores of a match by label, by symbol, by module alone, by star; most targets of a module.
LABEL_SCORE, SYMBOL_SCORE, MODULE_SCORE, STAR_SCORE, CALL_SCORE = 0.8, 0.85, 0.8, 0.7, 0.5
MOST_TARGETS = 50
#: Extensions by the way their imports are written.
FAMILIES = {
    "script": ("js", "jsx", "ts", "tsx", "mjs", "mts", "cts", "vue", "svelte", "astro"),
    "go": ("go",),
    "rust": ("rs",),
    "dotted": ("java", "cs", "kt", "kts", "scala", "swift", "groovy", "gradle"),
    "include": ("c", "h", "cpp", "cc", "cxx", "hpp", "cu", "cuh", "metal", "m", "mm"),
    "backslash": ("php",),
    "dart": ("dart",),
    "python": ("py",),
}


def import_family(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, exts in FAMILIES.items():
        out = F.when(extension(path).isin(*exts), name).otherwise(out)
    return out


def _from_end(parts: Column, n: int) -> Column:
    """The n-th part from the end, or null."""
    return F.get(parts, F.size(parts) - n)


def _bare(part: Column) -> Column:
    return F.regexp_replace(part, r"^\.+", "")


def candidates(family: Column, label: Column) -> Column:
    """Ordered (stem, package, only) candidates of an import label.

    ``package`` marks names of package folders; ``only`` names the one label wanted
    of the module, if it has that label at all.
    """
    no = F.lit(None).cast("string")

    def one(stem: Column, only: Column = no, package: bool = False) -> Column:
        return F.struct(stem.alias("stem"), F.lit(package).alias("package"), only.alias("only"))

    plain = F.regexp_replace(label, r" as .*$", "")
    slashes = F.split(plain, "/")
    script = F.array(
        one(F.when(F.size(slashes) > 1, _bare(F.get(slashes, F.lit(0))))),
        one(_bare(_from_end(slashes, 1))),
        one(F.regexp_replace(plain, r"^(\./)*(\.\./)*", "")),
        one(F.when(label.contains("/") | label.startswith("."), F.lit("index"))),
    )
    quoted = F.regexp_extract(label, '"([^"]*)"', 1)
    package = F.element_at(F.split(F.when(quoted != "", quoted).otherwise(F.regexp_replace(label, r"^(\. |_ )+", "")), "/"), -1)
    go = F.array(one(package, package=True), one(package))
    colons = F.split(F.regexp_replace(label, "^pub use ", ""), "::")
    star = _from_end(colons, 1) == "*"
    rust = F.array(
        one(F.when(star, _from_end(colons, 2))), one(F.when(~star, _from_end(colons, 1))), one(_from_end(colons, 2), F.when(~star, _from_end(colons, 1)))
    )
    dots = F.split(F.btrim(F.regexp_replace(F.regexp_replace(label, "^static ", ""), "^.*? = ", "")), r"\.")
    dotted = F.array(one(_from_end(dots, 1)), one(_from_end(dots, 2), _from_end(dots, 1)))
    include = F.array(one(F.regexp_replace(F.element_at(F.split(F.regexp_replace(label, r'^[<"]+|[>"]+$', ""), "/"), -1), r"(?<=.)\.[^.]*$", "")))
    back = F.split(label, r"\\")
    backslash = F.array(one(_from_end(back, 1)), one(_from_end(back, 2)))
    named = F.regexp_replace(F.regexp_replace(label, "^(import|export|part) ", ""), r"( deferred| as ).*$", "")
    dart = F.array(one(F.regexp_replace(F.element_at(F.split(F.regexp_replace(F.btrim(named, F.lit(" '\"")), "^package:", ""), "/"), -1), r"\.dart$", "")))
    out = F.array().cast("array<struct<stem:string,package:boolean,only:string>>")
    for name, value in {"script": script, "go": go, "rust": rust, "dotted": dotted, "include": include, "backslash": backslash, "dart": dart}.items():
        out = F.when(family == name, value).otherwise(out)
    return out


def entities(g: Graph) -> DataFrame:
    """(entity, label, stem, folder): what files define; the folder names the package of a Go file."""
    defined = g.edges.where("relation = 'defines'").select(F.col("target").alias("id")).distinct()
    n = g.nodes.where("node_type <> 'file' and source_file <> ''").join(defined, "id", "left_semi")
    folder = F.when(extension(F.col("source_file")) == "go", F.regexp_extract("source_file", r"([^/]+)/[^/]+$", 1))
    return n.select(F.col("id").alias("entity"), "label", "source_file", file_stem(F.col("source_file")).alias("stem"), folder.alias("folder"))


def imports(g: Graph) -> DataFrame:
    """(source, source_file, label): import edges with the label of what they name."""
    label = g.nodes.select(F.col("id").alias("target"), "label")
    return g.edges.where("relation = 'imports'").select("source", "target", "source_file").join(label, "target").select("source", "source_file", "label")


def resolved(imported: DataFrame, known: DataFrame) -> DataFrame:
    """(source, source_file, label, entity, entity_label): all entities of the first candidate that has any.

    Of a candidate that wants one label only the entities of that label count, if there are any.
    """
    c = imported.select("*", F.posexplode(candidates(import_family(F.col("source_file")), F.col("label"))).alias("at", "c"))
    c = c.select("source", "source_file", "label", "at", "c.stem", "c.package", "c.only").where("stem is not null and stem <> ''")
    names = known.select("entity", F.col("label").alias("entity_label"), "stem", F.lit(False).alias("package")).unionAll(
        known.where("folder <> ''").select("entity", F.col("label").alias("entity_label"), F.col("folder").alias("stem"), F.lit(True).alias("package"))
    )
    hits = c.join(names, ["stem", "package"])
    of = Window.partitionBy("source", "source_file", "label")
    first = hits.withColumn("best", F.min("at").over(of)).where("at = best")
    wanted = F.max(F.coalesce(F.col("entity_label") == F.col("only"), F.lit(False))).over(of)
    first = first.withColumn("wanted", wanted).where(~F.col("wanted") | (F.col("entity_label") == F.col("only")))
    return first.select("source", "source_file", "label", "entity", "entity_label").distinct()


def _edges(rows: DataFrame, relation: str, score: Column | float, provenance: str) -> DataFrame:
    value = score if isinstance(score, Column) else F.lit(score)
    out = rows.select(
        "source", "target", F.lit(relation).alias("relation"), F.lit("INFERRED").alias("confidence"), value.alias("confidence_score"), value.alias("weight"),
        "source_file", F.lit(provenance).alias("provenance"),
    )
    return complete(out, EDGE_SCHEMA)


def cross_file_uses(g: Graph) -> DataFrame:
    """``uses`` edges from the entities of the importing file to those the import means.

    Three tiers per entity and import: targets with the entity's own label; else those
    the import names as a symbol; else all, ``MOST_TARGETS`` at most in label order.  A pair counts once, at its best score.
    """
    known = entities(g)
    local = known.select(F.col("entity").alias("source"), F.col("label").alias("own"), "source_file")
    hits = resolved(imports(g), known).drop("source").join(local, "source_file").where("source <> entity")
    symbol = F.regexp_extract("label", r"([^/.:\\ ]+)$", 1)
    tier = F.when(F.col("entity_label") == F.col("own"), 1).when(F.col("entity_label") == symbol, 2).otherwise(3)
    of = Window.partitionBy("source", "source_file", "label")
    hits = hits.withColumn("tier", tier).withColumn("best", F.min("tier").over(of)).where("tier = best")
    hits = hits.withColumn("nth", F.row_number().over(of.orderBy("entity_label", "entity"))).where(F.col("nth") <= MOST_TARGETS)
    score = F.when(F.col("tier") == 1, LABEL_SCORE).when(F.col("tier") == 2, SYMBOL_SCORE).otherwise(MODULE_SCORE)
    rows = hits.groupBy("source", F.col("entity").alias("target"), "source_file").agg(F.max(score).alias("score"))
    return _edges(rows, "uses", F.col("score"), "cross-file:import")


def python_imports(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(import edges, star ``uses`` edges).

    An import leads to the node its target names as a label: one of the same file,
    else the first by id.  A star import uses every entity of the module's files.
    """
    label = g.nodes.select(F.col("id").alias("target"), F.col("label").alias("import_label"))
    e = g.edges.where("relation = 'imports'").join(label, "target", "left")
    star = F.coalesce(F.col("import_label").contains("*"), F.lit(False))
    named = g.nodes.select(F.col("label").alias("target"), F.col("id").alias("to"), F.col("source_file").alias("to_file"))
    near = F.struct((F.col("to_file") != F.col("source_file")).alias("far"), F.col("to").alias("to"))
    found = e.where(~star).join(named, "target").groupBy("source", "target", "source_file").agg(F.min(near).alias("to"))
    kept = g.edges.where("relation = 'imports'").join(found, ["source", "target", "source_file"], "left")
    moved = kept.withColumn("confidence", F.when(F.col("to").isNotNull(), "EXTRACTED").otherwise(F.col("confidence"))).withColumn(
        "target", F.coalesce("to.to", "target")
    ).select(*g.edges.columns)
    module = F.regexp_replace("import_label", r"(\.\*| \*)+$", "")
    all_of = e.where(star).select("source", "source_file", module.alias("stem")).join(entities(g).select(F.col("entity").alias("target"), "stem"), "stem")
    return moved, _edges(all_of.select("source", "target", "source_file").distinct(), "uses", STAR_SCORE, "cross-file:star-import")


def calls_from_uses(g: Graph, uses: DataFrame) -> DataFrame:
    """``calls`` edges for ``uses`` edges that start at something callable, where there is no call yet."""
    callable_ = g.nodes.where("node_type in ('function', 'method')").select(F.col("id").alias("source"))
    done = g.edges.where("relation = 'calls'").select("source", "target")
    rows = uses.join(callable_, "source", "left_semi").join(done, ["source", "target"], "left_anti")
    return _edges(rows.select("source", "target", "source_file"), "calls", CALL_SCORE, "cross-file:call")


def linked_graph(g: Graph) -> Graph:
    """The graph with imports resolved: Python targets, ``uses`` across files and the calls they imply."""
    moved, star = python_imports(g)
    uses = cross_file_uses(g).unionByName(star)
    calls = calls_from_uses(g, uses)
    rest = g.edges.where("relation <> 'imports'")
    return Graph(g.nodes, rest.unionByName(moved).unionByName(uses).unionByName(calls), g.hyperedges)


def markdown_links(files: DataFrame) -> DataFrame:
    """``references`` edges from (path, content) Markdown files to the files of the corpus that they link to.

    A target is tried as a path, as a path with ``.md``, then as the stem of one file only.
    """
    docs = files.where(extension(F.col("path")) == "md").select("path", F.explode(link_targets(F.col("content").cast("string"))).alias("target"))
    parent = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    at = normalize_path(F.when(F.col("target").startswith("/"), F.substring("target", 2, 1 << 30)).otherwise(F.concat(parent, F.col("target"))))
    name = F.element_at(F.split("target", "/"), -1)
    bare = ~name.rlike(r".\.[^.]+$")
    docs = docs.select("path", at.alias("at"), F.when(bare, F.concat(at, F.lit(".md"))).alias("at_md"), F.when(bare, F.lower(name)).alias("at_stem"))
    known = files.select(F.col("path").alias("to"), normalize_path(F.col("path")).alias("norm"))
    stems = known.groupBy(F.lower(file_stem(F.col("to"))).alias("s")).agg(F.min("to").alias("by_stem"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    a, b = known.select(F.col("norm").alias("at"), F.col("to").alias("exact")), known.select(F.col("norm").alias("at_md"), F.col("to").alias("with_md"))
    j = docs.join(a, "at", "left").join(b, "at_md", "left").join(stems, F.col("at_stem") == F.col("s"), "left")
    j = j.select("path", F.coalesce("exact", "with_md", "by_stem").alias("to")).where("to is not null and to <> path").distinct()
    out = j.select(
        make_id(F.col("path")).alias("source"), make_id(F.col("to")).alias("target"), F.lit("references").alias("relation"), F.col("path").alias("source_file"),
        F.lit("markdown-links").alias("provenance"),
    )
    return complete(out, EDGE_SCHEMA)
