"""Source trees, change snapshots and interchange documents as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import is_ignored
from skein.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph, complete
from skein.operators.build import drop_dangling, first_wins

#: Extensions by kind of file.
KINDS = {
    "code": (
        "py", "ts", "js", "jsx", "tsx", "vue", "go", "rs", "java", "cpp", "cc", "cxx", "c", "h", "hpp", "rb", "swift", "kt", "kts", "cs", "scala", "php", "lua", "toc",
        "zig", "ps1", "ex", "exs", "m", "mm", "jl", "dart", "cu", "cuh", "metal", "svelte", "astro", "groovy", "gradle", "v", "sv", "svh", "sql", "f", "f90", "f95", "f03",
        "f08", "pas", "pp", "dpr", "dpk", "lpr", "cls", "trigger", "tf", "tfvars", "hcl", "sh", "bash", "json", "sln", "csproj", "fsproj", "vbproj", "xaml", "razor",
        "cshtml", "dm", "dme", "dmm", "mts", "cts", "mjs", "luau", "psm1", "psd1", "inc", "dfm", "lfm", "slnx",
    ),
    "document": ("md", "txt", "rst", "mdx", "qmd", "yaml", "yml", "docx", "xlsx"),
    "paper": ("pdf",),
    "image": ("png", "jpg", "jpeg", "gif", "webp", "svg"),
    "media": ("mp4", "mov", "avi", "mkv", "webm", "m4v", "mp3", "wav", "m4a", "flac", "ogg", "opus"),
}
#: Package manifests, code whatever their extension.
MANIFESTS = ("apm.yml", "apm.yaml", "pyproject.toml", "go.mod", "pom.xml")
#: Directories without sources (besides those that begin with a dot).
NOISE_DIRS = ("venv", "env", "node_modules", "__pycache__", "dist", "build", "target", "out", "site-packages", "lib64")
#: Extensions, names, words of names and directories of sensitive files; extensions whose names may hold the words.
SENSITIVE_EXTENSIONS = ("pem", "key", "p12", "pfx", "cert", "crt", "der", "p8")
SENSITIVE_NAMES = (
    ".env", ".envrc", ".netrc", ".pgpass", ".htpasswd", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "id_rsa.pub", "id_dsa.pub", "id_ecdsa.pub", "id_ed25519.pub",
    "aws_credentials", "gcloud_credentials",
)
SENSITIVE_WORDS = (
    "credentials", "secret", "passwd", "password", "private_key", "service.account", "access_token", "auth_token", "refresh_token", "id_token", "api_token", "oauth_token",
    "bearer_token",
)
SENSITIVE_DIRS = ("secrets", "credentials", ".ssh", ".gnupg", ".aws", ".kube")
WORDS_ALLOWED = ("cs", "html", "ts", "js", "tsx", "jsx", "vue")
#: Signs of a paper, case aside; so many of them in so many leading bytes make one.
PAPER_SIGNS = (
    r"arxiv", r"\bdoi\b", r"\babstract\b", r"proceedings", r"\bjournal\b", r"preprint", r"\\cite\{", r"\[\d+\]", r"\beq\.", r"\bequation\b", r"\d{4}\.\d{4,5}", r"we propose",
    r"literature",
)
PAPER_SIGNS_LEAST, PAPER_HEAD = 3, 3000


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_kind(path: Column, head: Column) -> Column:
    """code, document, paper, image or media; a text document with enough signs of a paper is one, pictures of an asset catalog are none."""
    ext, name = extension(path), F.element_at(F.split(path, "/"), -1)
    kind = F.lit(None).cast("string")
    for k, exts in KINDS.items():
        kind = F.when(ext.isin(*exts), k).otherwise(kind)
    signs = sum((head.rlike("(?i)" + p).cast("int") for p in PAPER_SIGNS), F.lit(0))
    asset = path.rlike(r"\.(imageset|xcassets)(/|$)") & kind.isin("paper", "image")
    return (
        F.when(F.lower(name).isin(*MANIFESTS), "code").when((kind == "document") & ~ext.isin("docx", "xlsx") & (signs >= PAPER_SIGNS_LEAST), "paper")
        .when(asset, F.lit(None)).otherwise(kind)
    )


def is_sensitive(path: Column) -> Column:
    """Key files, named files, names with a telling word between ``_`` and ``.``, files in telling directories; case aside."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    words = "|".join(w.replace(".", r"\.") for w in SENSITIVE_WORDS)
    word = stem.rlike(rf"(^|[_.])({words})([_.]|$)") & ~extension(path).isin(*WORDS_ALLOWED)
    folder = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda d: d.isin(*SENSITIVE_DIRS))
    return extension(path).isin(*SENSITIVE_EXTENSIONS) | name.isin(*SENSITIVE_NAMES) | word | folder


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, file_type, size, mtime, words, hash, content) of the files under ``root``, paths relative to it."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", ""), "^\\Q" + base + "\\E/", "")
    text = F.decode("content", "UTF-8")
    f = f.select(path.alias("path"), F.col("length").alias("size"), "modificationTime", "content")
    noisy = F.exists(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda s: s.isin(*NOISE_DIRS) | s.startswith("."))
    f = f.where(~noisy & ~is_sensitive(F.col("path")))
    if ignore:
        f = f.where(~is_ignored(F.col("path"), ignore))
    readable = extension(F.col("path")).isin(*KINDS["code"], "md", "txt", "rst", "mdx", "qmd", "yaml", "yml", "toml", "mod", "xml")
    words = F.when(readable, F.size(F.filter(F.split(F.try_validate_utf8(F.col("content").cast("string")), r"\s+"), lambda w: w != ""))).otherwise(0)
    return f.select(
        "path", file_kind(F.col("path"), F.when(readable, F.substring(F.col("content").cast("string"), 1, PAPER_HEAD)).otherwise("")).alias("file_type"),
        "size", F.unix_micros("modificationTime").alias("mtime"), F.coalesce(words, F.lit(0)).alias("words"), F.sha2("content", 256).alias("hash"), "content",
    ).where("file_type is not null")


def totals(files: DataFrame) -> DataFrame:
    """(file_type, files, words), and a row of all types with whether a graph is worth while (two files or more)."""
    t = files.groupBy("file_type").agg(F.count(F.lit(1)).alias("files"), F.sum("words").alias("words")).withColumn("needs_graph", F.lit(None).cast("boolean"))
    every = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    return t.unionAll(every.select(F.lit("all"), "files", "words", F.col("files") >= 2))


def sources(files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """The files an extractor reads, by path."""
    return files.where(extension(F.col("path")).isin(*extensions)).orderBy("path")


def rescan(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, status): added, removed, changed or same.

    Equal time and size count as the same without a look at the hash.
    """
    c = current.select("path", F.struct("mtime", "size", "hash").alias("c"))
    s = snapshot.select("path", F.struct("mtime", "size", "hash").alias("s"))
    status = (
        F.when(F.col("s").isNull(), "added").when(F.col("c").isNull(), "removed")
        .when((F.col("c.mtime") == F.col("s.mtime")) & (F.col("c.size") == F.col("s.size")), "same")
        .when(F.col("c.hash") == F.col("s.hash"), "same").otherwise("changed")
    )
    return c.join(s, "path", "full").select("path", status.alias("status"))


def quick_scan(listing: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, mtime, size, words, hash, status) of a listing (path, mtime, size, content) against the last snapshot.

    Words and hash of a file with the same time and size are those of the snapshot;
    its content is not looked at, so the column need not be read for it.
    """
    s = snapshot.select("path", F.struct("mtime", "size", "words", "hash").alias("s"))
    j = listing.join(s, "path", "left")
    same = F.coalesce((F.col("mtime") == F.col("s.mtime")) & (F.col("size") == F.col("s.size")), F.lit(False))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    words = F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0)).cast("long")
    got = F.when(same, F.struct(F.col("s.words").cast("long").alias("words"), F.col("s.hash").alias("hash"))).otherwise(
        F.struct(words.alias("words"), F.sha2("content", 256).alias("hash"))
    )
    out = j.select("path", "mtime", "size", "s", got.alias("g"))
    status = F.when(F.col("s").isNull(), "added").when(F.col("s.hash") == F.col("g.hash"), "same").otherwise("changed")
    return out.select("path", "mtime", "size", "g.words", "g.hash", status.alias("status"))


def has_changed(scanned: DataFrame, snapshot: DataFrame) -> bool:
    """Whether a file is new, other or gone."""
    return scanned.where("status <> 'same'").limit(1).count() > 0 or scanned.count() != snapshot.count()


def save_snapshot(scanned: DataFrame, path: str) -> None:
    """Write the snapshot beside the old one and swap the folders, so a reader finds one of the two."""
    spark = scanned.sparkSession
    jvm = spark.sparkContext._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(path + ".new"), jvm.org.apache.hadoop.fs.Path(path)
    scanned.select("path", "mtime", "size", "words", "hash").write.mode("overwrite").parquet(path + ".new")
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    fs.rename(new, old)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The last snapshot; an empty one if there is none."""
    schema = "path string, mtime long, size long, words long, hash string"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if found else spark.createDataFrame([], schema)


def read_node_link(spark: SparkSession, path: str) -> Graph:
    """A node-link JSON document; repeated nodes and dangling links are skipped, hyperedges read."""
    node = "struct<id:string,label:string,source_file:string,source_location:string,node_type:string,community:bigint>"
    link = "struct<source:string,target:string,relation:string,confidence:string,confidence_score:double,source_file:string,source_location:string,weight:double>"
    hyper = "struct<nodes:array<string>,relation:string,label:string>"
    d = spark.read.schema(f"nodes array<{node}>, links array<{link}>, hyperedges array<{hyper}>").option("multiLine", "true").json(path)
    n = d.select(F.posexplode("nodes").alias("_ord", "n")).select("n.*", "_ord").where("id is not null")
    e = d.select(F.posexplode("links").alias("_ord", "e")).select("e.*", "_ord").where("source is not null and target is not null")
    e = e.withColumn("relation", F.coalesce("relation", F.lit("related_to")))
    nodes = first_wins(complete(n, NODE_SCHEMA), ["id"])
    return Graph(nodes, drop_dangling(nodes, complete(e, EDGE_SCHEMA)), d.select(F.explode("hyperedges").alias("h")).select("h.*"))


def memory_docs(files: DataFrame) -> DataFrame:
    """(path, question, outcome, correction, ts, nodes) from the front matter of notes (path, text)."""
    front = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---", 1)
    field = lambda k: F.nullif(F.btrim(F.regexp_extract(front, rf"(?m)^{k}:[ \t]*(.*)$", 1), F.lit(" \"'")), F.lit(""))
    listed = F.regexp_extract(front, r"(?m)^nodes:[ \t]*\[(.*)\]", 1)
    nodes = F.filter(F.transform(F.split(listed, ","), lambda x: F.btrim(x, F.lit(" \"'"))), lambda x: x != "")
    return files.select(
        "path", field("question").alias("question"), field("outcome").alias("outcome"), field("correction").alias("correction"),
        F.try_to_timestamp(field("timestamp")).alias("ts"), F.array_distinct(nodes).alias("nodes"),
    )
