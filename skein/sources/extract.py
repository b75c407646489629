"""Facts from source files: definitions, imports and calls by language rules.

A rule table names, for each language, the patterns of definitions and imports.
Lines are exploded and matched in columns; scopes and calls are joins, so a large
repository is one distributed pass.  Calls are found by cutting bodies into
identifiers and joining them to the functions of the file, not by trying every
name on every body.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import COMMENT_MARKERS, RATIONALE_TAGS, file_stem, make_id
from skein.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph, complete
from skein.operators.build import first_wins
from skein.sources.files import extension


@dataclass(frozen=True)
class Rules:
    """(kind, pattern with the name in group 1) of definitions; patterns of imports."""

    extensions: tuple[str, ...]
    definitions: tuple[tuple[str, str], ...]
    imports: tuple[str, ...] = ()
    family: dict = field(default_factory=dict)


_NAME = r"([A-Za-z_]\w*)"
LANGUAGES: dict[str, Rules] = {
    "python": Rules(("py",), (("class", rf"^\s*class\s+{_NAME}"), ("function", rf"^\s*(?:async\s+)?def\s+{_NAME}")), (r"^\s*import\s+([\w.]+)", r"^\s*from\s+([\w.]+)\s+import")),
    "javascript": Rules(
        ("js", "jsx", "ts", "tsx", "mjs", "mts", "cts", "vue", "svelte", "astro"),
        (("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}"), ("interface", rf"^\s*(?:export\s+)?interface\s+{_NAME}"),
         ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+{_NAME}"), ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?\([^)]*\)\s*=>")),
        (r"""^\s*import\s.*?from\s+['"]([^'"]+)['"]""", r"""^\s*import\s+['"]([^'"]+)['"]""", r"""require\(\s*['"]([^'"]+)['"]\s*\)"""),
    ),
    "go": Rules(("go",), (("struct", rf"^type\s+{_NAME}\s+struct\b"), ("interface", rf"^type\s+{_NAME}\s+interface\b"), ("function", rf"^func\s+(?:\([^)]*\)\s*)?{_NAME}\s*\(")), (r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*$',)),
    "rust": Rules(
        ("rs",),
        (("struct", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_NAME}"), ("enum", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_NAME}"), ("trait", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+{_NAME}"),
         ("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+{_NAME}")),
        (r"^\s*(?:pub\s+)?use\s+([\w:]+)",),
    ),
    "java": Rules(("java",), (("class", rf"^\s*(?:[\w@]+\s+)*class\s+{_NAME}"), ("interface", rf"^\s*(?:\w+\s+)*interface\s+{_NAME}"), ("enum", rf"^\s*(?:\w+\s+)*enum\s+{_NAME}"),
                              ("method", r"^\s+(?:(?:public|private|protected|static|final|synchronized|abstract)\s+)+[\w<>\[\], ?]+\s+([A-Za-z_]\w*)\s*\(")), (r"^\s*import\s+(?:static\s+)?([\w.]+)",)),
    "c": Rules(("c", "h", "cpp", "hpp", "cc", "cxx", "cu", "cuh", "metal"), (("class", rf"^\s*class\s+{_NAME}"), ("struct", rf"^\s*(?:typedef\s+)?struct\s+{_NAME}"), ("function", r"^(?!\s*(?:return|else|if|while|for|switch)\b)[A-Za-z_][\w\s*&:<>,]*?[\s*&]([A-Za-z_]\w*)\s*\([^;]*$")), (r'^\s*#\s*include\s+[<"]([^>"]+)[>"]',)),
    "ruby": Rules(("rb",), (("module", rf"^\s*module\s+{_NAME}"), ("class", rf"^\s*class\s+{_NAME}"), ("method", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)")), (r"""^\s*require(?:_relative)?\s+['"]([^'"]+)['"]""",)),
    "csharp": Rules(("cs",), (("namespace", r"^\s*namespace\s+([\w.]+)"), ("class", rf"^\s*(?:\w+\s+)*class\s+{_NAME}"), ("interface", rf"^\s*(?:\w+\s+)*interface\s+{_NAME}"), ("struct", rf"^\s*(?:\w+\s+)*struct\s+{_NAME}"),
                              ("enum", rf"^\s*(?:\w+\s+)*enum\s+{_NAME}"), ("method", r"^\s+(?:(?:public|private|protected|internal|static|virtual|override|async)\s+)+[\w<>\[\], ?]+\s+([A-Za-z_]\w*)\s*\(")), (r"^\s*using\s+([\w.]+)\s*;",)),
    "kotlin": Rules(("kt", "kts"), (("class", rf"^\s*(?:\w+\s+)*(?:class|object|interface)\s+{_NAME}"), ("function", rf"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?{_NAME}\s*\(")), (r"^\s*import\s+([\w.]+)",)),
    "scala": Rules(("scala",), (("class", rf"^\s*(?:\w+\s+)*(?:class|object|trait)\s+{_NAME}"), ("function", rf"^\s*(?:\w+\s+)*def\s+{_NAME}")), (r"^\s*import\s+([\w.]+)",)),
    "php": Rules(("php",), (("class", rf"^\s*(?:\w+\s+)*(?:class|interface|trait)\s+{_NAME}"), ("function", rf"^\s*(?:\w+\s+)*function\s+&?{_NAME}")), (r"^\s*use\s+([\w\\]+)",)),
    "swift": Rules(("swift",), (("class", rf"^\s*(?:\w+\s+)*(?:class|struct|enum|protocol)\s+{_NAME}"), ("function", rf"^\s*(?:\w+\s+)*func\s+{_NAME}")), (r"^\s*import\s+(\w+)",)),
    "lua": Rules(("lua", "luau"), (("function", r"^\s*(?:local\s+)?function\s+([\w.:]+)"),), (r"""require\s*\(?\s*['"]([^'"]+)['"]""",)),
    "shell": Rules(("sh", "bash"), (("function", rf"^\s*(?:function\s+)?{_NAME}\s*\(\)\s*\{{?"),), (r"^\s*(?:source|\.)\s+(\S+)",)),
    "fortran": Rules(("f", "f90", "f95", "f03", "f08"), (("module", rf"(?i)^\s*module\s+(?!procedure){_NAME}"), ("function", rf"(?i)^\s*(?:\w+\s+)*(?:subroutine|function)\s+{_NAME}")), (r"(?i)^\s*use\s+(\w+)",)),
    "dart": Rules(("dart",), (("class", rf"^\s*(?:abstract\s+)?(?:class|mixin|extension)\s+{_NAME}"), ("enum", rf"^\s*enum\s+{_NAME}"), ("function", r"^\s*(?:static\s+)?[\w<>?]+\s+([A-Za-z_]\w*)\s*\([^;]*(?:\{|=>)")), (r"""^\s*(?:import|export|part)\s+['"]([^'"]+)['"]""",)),
    "groovy": Rules(("groovy", "gradle"), (("class", rf"^\s*(?:\w+\s+)*(?:class|interface|trait)\s+{_NAME}"), ("function", rf"^\s*(?:\w+\s+)*def\s+{_NAME}\s*\(")), (r"^\s*import\s+(?:static\s+)?([\w.]+)",)),
    "pascal": Rules(("pas", "pp", "dpr", "dpk", "lpr", "inc"), (("module", rf"(?i)^\s*(?:unit|program|library)\s+{_NAME}"), ("class", rf"(?i)^\s*{_NAME}\s*=\s*(?:class|record|interface)\b"), ("function", r"(?i)^\s*(?:class\s+)?(?:procedure|function|constructor|destructor)\s+(?:\w+\.)?([A-Za-z_]\w*)")), (r"(?i)^\s*uses\s+([\w.]+)",)),
    "elixir": Rules(("ex", "exs"), (("module", r"^\s*defmodule\s+([\w.]+)"), ("function", r"^\s*defp?\s+([a-z_]\w*[?!]?)"), ("trait", r"^\s*defprotocol\s+([\w.]+)")), (r"^\s*(?:alias|import|use|require)\s+([\w.]+)",)),
    "zig": Rules(("zig",), (("struct", rf"^\s*(?:pub\s+)?const\s+{_NAME}\s*=\s*(?:packed\s+|extern\s+)?struct\b"), ("enum", rf"^\s*(?:pub\s+)?const\s+{_NAME}\s*=\s*enum\b"), ("function", rf"^\s*(?:pub\s+)?(?:inline\s+|export\s+)?fn\s+{_NAME}")), (r'@import\("([^"]+)"\)',)),
    "julia": Rules(("jl",), (("module", rf"^\s*module\s+{_NAME}"), ("struct", rf"^\s*(?:mutable\s+)?struct\s+{_NAME}"), ("function", r"^\s*(?:function|macro)\s+([A-Za-z_]\w*!?)"), ("function", r"^([a-z_]\w*!?)\([^)]*\)\s*=(?!=)")), (r"^\s*(?:using|import)\s+([\w.]+)",)),
    "objc": Rules(("m", "mm"), (("class", rf"^\s*@(?:interface|implementation)\s+{_NAME}"), ("interface", rf"^\s*@protocol\s+{_NAME}"), ("function", r"^\s*[-+]\s*\([^)]*\)\s*([A-Za-z_]\w*)")), (r'^\s*#\s*import\s+[<"]([^>"]+)[>"]',)),
    "powershell": Rules(("ps1", "psm1", "psd1"), (("function", r"(?i)^\s*(?:function|filter)\s+([\w-]+)"), ("class", rf"(?i)^\s*class\s+{_NAME}"), ("enum", rf"(?i)^\s*enum\s+{_NAME}")), (r"(?i)^\s*(?:using\s+module|import-module)\s+(\S+)",)),
    "apex": Rules(("cls", "trigger"), (("class", rf"(?i)^\s*(?:\w+\s+)*class\s+{_NAME}"), ("interface", rf"(?i)^\s*(?:\w+\s+)*interface\s+{_NAME}"), ("enum", rf"(?i)^\s*(?:\w+\s+)*enum\s+{_NAME}"), ("class", rf"(?i)^\s*trigger\s+{_NAME}\s+on\b"), ("method", r"(?i)^\s+(?:(?:public|private|protected|global|static|override|virtual)\s+)+[\w<>\[\], ]+\s+([A-Za-z_]\w*)\s*\("))),
    "dm": Rules(("dm", "dme"), (("class", r"^/((?:obj|mob|turf|area|datum)(?:/\w+)*)\s*$"), ("function", r"^(?:/[\w/]+)?/(?:proc|verb)/(\w+)\s*\(")), (r'^\s*#include\s+"([^"]+)"',)),
    "verilog": Rules(("sv", "v", "svh"), (("module", rf"^\s*module\s+{_NAME}"), ("class", rf"^\s*class\s+{_NAME}"), ("function", rf"^\s*(?:function|task)\s+(?:\w+\s+)*{_NAME}\s*[(;]")), (r"^\s*import\s+(\w+)",)),
}
#: Files of statements: what the words after CREATE make.
STATEMENTS = {"table": "class", "view": "interface", "function": "function", "procedure": "function"}
#: Files of blocks: what the first word of a block's head makes; the last quoted word names it.
BLOCKS = {"resource": "class", "data": "struct", "module": "module", "variable": "variable", "output": "constant"}
CALLABLE = ("function", "method")
TYPES = ("class", "struct", "interface", "trait", "enum", "module")


def _declared(line, lang):
    """(kind, name) of a SQL statement's or a configuration block's first line, from its words."""
    words = F.split(F.btrim(F.lower(line)), r"[\s(]+")
    makes = F.array_intersect(F.slice(words, 2, 4), F.array(*[F.lit(w) for w in STATEMENTS]))
    object_ = F.get(makes, F.lit(0))
    # The name is the first word after the kind that is none of IF NOT EXISTS.
    after = F.filter(F.slice(F.split(F.btrim(line), r"[\s(]+"), F.greatest(F.array_position(words, object_), F.lit(1)).cast("int") + 1, 5), lambda w: ~F.lower(w).isin("if", "not", "exists", "or", "replace", ""))
    statement = (lang == "sql") & (F.get(words, F.lit(0)) == "create") & object_.isNotNull()
    head = F.regexp_extract(F.btrim(line), "^([a-z]+)", 1)
    quoted = F.regexp_extract_all(line, F.lit('"([^"]+)"'), F.lit(1))
    block = (lang == "terraform") & head.isin(*BLOCKS) & (F.size(quoted) > 0) & (line == F.ltrim(line))
    pick = lambda key, table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    kind = F.when(statement, pick(object_, STATEMENTS)).when(block, pick(head, BLOCKS))
    return kind, F.when(statement, F.regexp_replace(F.get(after, F.lit(0)), r'["`;]', "")).when(block, F.element_at(quoted, -1))


def _language(path):
    out = F.lit(None).cast("string")
    for name, r in LANGUAGES.items():
        out = F.when(extension(path).isin(*r.extensions), name).otherwise(out)
    return F.when(extension(path) == "sql", "sql").when(extension(path).isin("tf", "tfvars", "hcl"), "terraform").otherwise(out)


def script_only(text):
    """A component file with everything outside its script blocks (or the block between ``---`` lines) blanked, lines kept."""
    lines = F.split(text, "\n")
    opens = lambda x: x.rlike(r"(?i)^\s*<script\b")
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("rules"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        rule = x.rlike(r"^---\s*$")
        ends = x.rlike(r"(?i)</script>")
        front = (acc["rules"] == 1) & ~rule
        keep = (acc["inside"] & ~ends) | front
        inside = F.when(opens(x) & ~ends, True).when(ends, False).otherwise(acc["inside"])
        return F.struct(inside.alias("inside"), (acc["rules"] + F.when(rule, 1).otherwise(0)).alias("rules"), F.concat(acc["out"], F.array(F.when(keep, x).otherwise(""))).alias("out"))

    return F.array_join(F.aggregate(lines, start, step)["out"], "\n")


def extract(files: DataFrame) -> Graph:
    """Nodes and edges of (path, content) source files.

    Every file is a node; definitions hang on their file by ``defines``, imports
    lead to module nodes by ``imports``, calls inside a file link functions.
    """
    text = F.col("content").cast("string")
    text = F.when(extension(F.col("path")).isin("vue", "svelte", "astro"), script_only(text)).otherwise(text)
    f = files.select("path", text.alias("text")).withColumn("lang", _language(F.col("path"))).where("lang is not null")
    lines = f.select("path", "lang", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    kind, name, target = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for lang, r in reversed(LANGUAGES.items()):
        for k, p in reversed(r.definitions):
            hit = (F.col("lang") == lang) & F.col("line").rlike(p)
            kind = F.when(hit, k).otherwise(kind)
            name = F.when(hit, F.regexp_extract("line", p, 1)).otherwise(name)
        for p in r.imports:
            target = F.when((F.col("lang") == lang) & F.col("line").rlike(p), F.regexp_extract("line", p, 1)).otherwise(target)
    said, called = _declared(F.col("line"), F.col("lang"))
    kind, name = F.coalesce(kind, said), F.coalesce(name, called)
    lines = lines.withColumn("kind", kind).withColumn("name", F.regexp_replace(name, '"', "")).withColumn("target", target)
    lines = lines.withColumn("indent", F.length("line") - F.length(F.ltrim("line")))

    in_file = Window.partitionBy("path").orderBy("at")
    upto = in_file.rowsBetween(Window.unboundedPreceding, -1)
    definition = F.col("kind").isNotNull()
    # The scope of a line: the last definition above it; a function right of a type's column is its method.
    scoped = lines.withColumn("scope", F.last(F.when(definition & F.col("kind").isin(*CALLABLE), F.col("name")), True).over(upto))
    scoped = scoped.withColumn("owner", F.last(F.when(definition & F.col("kind").isin(*TYPES), F.struct("name", "indent")), True).over(upto))
    is_method = (F.col("kind") == "function") & (F.col("owner.indent") < F.col("indent"))
    defs = scoped.where(definition).withColumn("kind", F.when(is_method, "method").otherwise(F.col("kind")))
    parent = F.when(F.col("kind") == "method", F.col("owner.name"))
    def_id = make_id(F.col("path"), F.coalesce(parent, F.lit("")), F.col("name"))
    file_id = make_id(F.col("path"))
    defs = defs.select("path", "at", "kind", "name", def_id.alias("id"), F.when(parent.isNotNull(), make_id(F.col("path"), parent)).otherwise(file_id).alias("up"))

    place = F.format_string("L%d", F.col("at") + 1)
    file_nodes = f.select(file_id.alias("id"), file_stem(F.col("path")).alias("label"), F.col("path").alias("source_file"), F.lit("file").alias("node_type"), F.lit(None).cast("string").alias("source_location"), F.lit(0).cast("long").alias("_ord"))
    def_nodes = defs.select("id", F.col("name").alias("label"), F.col("path").alias("source_file"), F.col("kind").alias("node_type"), place.alias("source_location"), (F.col("at") + 1).cast("long").alias("_ord"))
    imports = lines.where("target is not null").select("path", "at", "target").dropDuplicates(["path", "target"])
    module_nodes = imports.select(make_id(F.col("target")).alias("id"), F.col("target").alias("label"), F.lit("").alias("source_file"), F.lit("module").alias("node_type"), F.lit(None).cast("string").alias("source_location"), F.lit(1 << 40).alias("_ord"))
    nodes = first_wins(complete(file_nodes.unionAll(def_nodes).unionAll(module_nodes), NODE_SCHEMA), ["id"], ["_ord", "source_file", "label"]).where("id <> ''")

    defines = defs.select(F.col("up").alias("source"), F.col("id").alias("target"), F.lit("defines").alias("relation"), F.col("path").alias("source_file"), place.alias("source_location"), F.lit("EXTRACTED").alias("confidence"))
    imported = imports.select(file_id.alias("source"), make_id(F.col("target")).alias("target"), F.lit("imports").alias("relation"), F.col("path").alias("source_file"), place.alias("source_location"), F.lit("EXTRACTED").alias("confidence"))
    used = scoped.where("kind is null and scope is not null").select("path", "at", "scope", F.explode(F.regexp_extract_all("line", F.lit(r"(?<![\w.])([A-Za-z_]\w*)\s*\("), F.lit(1))).alias("callee"))
    word = scoped.where("kind is null and scope is not null and lang = 'shell'").select("path", "at", "scope", F.explode(F.regexp_extract_all("line", F.lit(r"(?<![\w$/.-])([A-Za-z_]\w*)\b"), F.lit(1))).alias("callee"))
    used = used.unionAll(word).withColumn("callee", F.lower("callee"))
    called = defs.where(F.col("kind").isin(*CALLABLE)).select("path", F.lower("name").alias("callee"), F.col("id").alias("target"))
    caller = defs.where(F.col("kind").isin(*CALLABLE)).select("path", F.col("name").alias("scope"), F.col("id").alias("source"))
    calls = used.join(called, ["path", "callee"]).join(caller, ["path", "scope"]).where("source <> target").groupBy("source", "target", "path").agg(F.min("at").alias("at"))
    calls = calls.select("source", "target", F.lit("calls").alias("relation"), F.col("path").alias("source_file"), place.alias("source_location"), F.lit("INFERRED").alias("confidence"))
    edges = complete(defines.unionAll(imported).unionAll(calls), EDGE_SCHEMA).dropDuplicates(["source", "target", "relation"])
    return Graph(nodes, edges)


def docstrings(files: DataFrame, least: int = 20) -> DataFrame:
    """(path, at, owner, text): Python docstrings of over ``least`` characters under the definition above them, or the file's own.

    Generated files (a line of their first five says so) have none.
    """
    f = files.where(extension(F.col("path")) == "py").select("path", F.col("content").cast("string").alias("text"))
    head = F.lower(F.array_join(F.slice(F.split("text", "\n"), 1, 5), "\n"))
    f = f.where(~head.rlike("generated by|auto-generated|autogenerated|do not edit"))
    lines = f.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    triple = r'^\s*[rRuU]?("""|\'\'\')'
    w = Window.partitionBy("path").orderBy("at")
    blank = F.btrim("line") == ""
    before = F.last(F.when(~blank, F.col("line")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    name = F.regexp_extract(before, r"^\s*(?:async\s+def|def|class)\s+([A-Za-z_]\w*)", 1)
    first = F.col("line").rlike(triple) & (before.isNull() | before.rlike(r":\s*(#.*)?$") & (name != ""))
    starts = lines.withColumn("owner", F.when(before.isNull(), "").otherwise(name)).withColumn("first", first).where("first").select("path", "at", "owner")
    texts = f.select("path", F.split("text", "\n").alias("lines"))
    body = F.array_join(F.slice("lines", F.col("at") + 1, F.size("lines")), "\n")
    doc = F.btrim(F.regexp_extract(body, r'(?s)^\s*[rRuU]?("""|\'\'\')(.*?)\1', 2))
    return starts.join(texts, "path").select("path", (F.col("at") + 1).alias("at"), "owner", F.regexp_replace(doc, r"\s+", " ").alias("text")).where(F.length("text") > least)


def resolve_imports(g: Graph) -> DataFrame:
    """``uses`` edges (source file, entity) for imports whose last segment is the stem of a file of the corpus."""
    stem = F.element_at(F.split(F.col("label"), r"[./:\\]+"), -1)
    modules = g.nodes.where("node_type = 'module' and source_file = ''").select(F.col("id").alias("target"), stem.alias("stem"))
    imports = g.edges.where("relation = 'imports'").select("source", "target").join(modules, "target").select("source", "stem")
    entities = g.nodes.where("source_file <> '' and node_type <> 'file'").select(F.col("id").alias("entity"), file_stem(F.col("source_file")).alias("stem"), "label")
    rn = F.row_number().over(Window.partitionBy("source", "stem").orderBy("label", "entity"))
    out = imports.join(entities, "stem").withColumn("rn", rn).where("rn <= 50")
    return complete(out.select("source", F.col("entity").alias("target"), F.lit("uses").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.8).alias("confidence_score")), EDGE_SCHEMA).dropDuplicates(["source", "target"])


def rationale_nodes(files: DataFrame) -> DataFrame:
    """(path, at, label): rationale comments of source files."""
    f = files.select("path", F.col("content").cast("string").alias("text")).withColumn("lang", _language(F.col("path"))).where("lang is not null")
    lines = f.select("path", "lang", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    label = F.lit(None).cast("string")
    tags = "|".join(RATIONALE_TAGS)
    for lang, markers in COMMENT_MARKERS.items():
        p = r"(?:" + "|".join("\\Q" + m + "\\E" for m in markers) + rf")\s*((?:{tags}):.*)$"
        label = F.when((F.col("lang") == lang) & F.col("line").rlike(p), F.substring(F.btrim(F.regexp_extract("line", p, 1)), 1, 80)).otherwise(label)
    return lines.select("path", (F.col("at") + 1).alias("at"), label.alias("label")).where("label is not null")
