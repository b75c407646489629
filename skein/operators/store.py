"""A store of graphs by repository, chunk merging and names that stay unique."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph, complete
from skein.operators.build import first_wins

MOST_NODES = 100_000


def unique_tags(paths: DataFrame) -> DataFrame:
    """(path, tag): the directory name; if several share it, with its parent; if still several, with a number."""
    parts = F.split(F.regexp_replace("path", "/+$", ""), "/")
    name, parent = F.element_at(parts, -1), F.get(parts, F.size(parts) - 2)
    p = paths.select("path", name.alias("name"), F.concat_ws("_", parent, name).alias("longer"))
    p = p.withColumn("tag", F.when(F.count(F.lit(1)).over(Window.partitionBy("name")) > 1, F.col("longer")).otherwise(F.col("name")))
    same = Window.partitionBy("tag")
    nth = F.row_number().over(same.orderBy("path"))
    return p.withColumn("nth", nth).select("path", F.when(F.col("nth") > 1, F.concat_ws("_", "tag", "nth")).otherwise(F.col("tag")).alias("tag"))


def end_lines(definitions: DataFrame, last_line: str = "last_line") -> DataFrame:
    """Adds ``end``: the line before the next definition of the file, or its last line. (path, line, last_line)"""
    after = F.lead("line").over(Window.partitionBy("path").orderBy("line"))
    return definitions.withColumn("end", F.coalesce(F.greatest(after - 1, F.col("line")), F.col(last_line)))


def merge_cached(cached: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both by key, the cached one first; rows without a key share one place."""
    both = cached.withColumn("_from", F.lit(0)).unionByName(new.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "_from")]
    return first_wins(both, [key], ["_from", *rest]).drop("_from")


def label_signature(membership: DataFrame) -> DataFrame:
    """(community, signature): 16 digits of a SHA-256 over the sorted ids, each followed by NUL."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda i: F.concat(i, F.lit("\x00"))), "")
    return membership.where("community is not null").groupBy("community").agg(F.substring(F.sha2(ids, 256), 1, 16).alias("signature"))


def carried_labels(membership: DataFrame, known: DataFrame) -> DataFrame:
    """(community, label): labels of communities whose signature is known; (signature, label)."""
    return label_signature(membership).join(known, "signature").select("community", "label")


def push_batches(g: Graph, size: int = 500) -> DataFrame:
    """(part, kind, batch, n): rows to push by label and relation, nodes first, ``size`` to a batch."""
    n = g.nodes.select(F.lit(0).alias("part"), F.col("node_type").alias("kind"), F.col("id").alias("key"))
    e = g.edges.select(F.lit(1), "relation", F.concat_ws("|", "source", "target"))
    rows = n.unionAll(e)
    # Numbered within a hash part, so that no task numbers a whole kind; a part's last batch may be short.
    part = F.pmod(F.xxhash64("key"), F.lit(64))
    nth = F.row_number().over(Window.partitionBy("part", "kind", part).orderBy("key")) - 1
    per = rows.withColumn("nth", nth).groupBy("part", "kind", part.alias("deal"), F.floor(F.col("nth") / size).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("part", "kind", F.concat_ws("-", "deal", "k").alias("batch"), "n")


class GraphStore:
    """Graphs of repositories in one folder, a Parquet pair and a hash for each; ``list``, ``add``, ``remove``, ``read``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def list(self) -> DataFrame:
        """(tag, hash, nodes) of what is stored."""
        p, fs = self._path()
        tags = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith("_")] if fs.exists(p) else []
        rows = self.spark.createDataFrame([], "tag string, hash string, nodes long")
        for t in sorted(tags):
            rows = rows.unionAll(self.spark.read.parquet(f"{self.root}/{t}/about").select("tag", "hash", "nodes"))
        return rows

    def add(self, tag: str, g: Graph, source_hash: str) -> bool:
        """Store a graph; False if the stored one has this hash.  Written beside the old one, then swapped."""
        known = {r.tag: r.hash for r in self.list().collect()}
        if known.get(tag) == source_hash:
            return False
        new = f"_new_{tag}"
        nodes = g.nodes.withColumn("extra", F.to_json(F.struct(F.lit(tag).alias("repo"))))
        complete(nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{self.root}/{new}/nodes")
        complete(g.edges.where("source <> target"), EDGE_SCHEMA).dropDuplicates(["source", "target", "relation"]).write.mode("overwrite").parquet(f"{self.root}/{new}/edges")
        count = self.spark.read.parquet(f"{self.root}/{new}/nodes").count()
        self.spark.createDataFrame([(tag, source_hash, count)], "tag string, hash string, nodes long").write.mode("overwrite").parquet(f"{self.root}/{new}/about")
        old, fs = self._path(tag)
        fs.delete(old, True)
        fs.rename(self._path(new)[0], old)
        return True

    def remove(self, tag: str) -> bool:
        p, fs = self._path(tag)
        return bool(fs.exists(p) and fs.delete(p, True))

    def read(self, tag: str) -> Graph:
        return Graph(self.spark.read.parquet(f"{self.root}/{tag}/nodes"), self.spark.read.parquet(f"{self.root}/{tag}/edges"))
