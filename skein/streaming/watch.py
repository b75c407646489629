"""Change-driven rebuild and streaming counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.graph import Graph
from skein.operators.build import first_wins

#: Parts of paths whose changes don't matter.
IGNORED = r"(/|^)(\.git|node_modules|target|__pycache__|dist|build)(/|$)|~$|\.swp$"


def watch_files(spark: SparkSession, root: str, rebuild: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand every batch of new or changed files (path, content) to ``rebuild``.

    ``once`` takes what is there and ends; else a batch starts every three seconds.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    s = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    s = s.where(~F.col("path").rlike(IGNORED)).select("path", "content")
    w = s.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="3 seconds")).start()


def upsert(state: Graph | None, batch: Graph, force: bool = False) -> Graph:
    """Replace what a batch's files held before; a batch must not lose nodes unless forced."""
    if state is None:
        return batch
    files = batch.nodes.where("source_file <> ''").select("source_file").distinct()
    nodes = state.nodes.join(files, "source_file", "left_anti").select(*batch.nodes.columns).unionByName(batch.nodes)
    edges = state.edges.join(files, "source_file", "left_anti").select(*batch.edges.columns).unionByName(batch.edges)
    new = Graph(first_wins(nodes, ["id"], ["_ord", "source_file"]), edges)
    if not force and new.nodes.count() < state.nodes.count():
        raise ValueError("the rebuilt graph has fewer nodes than the one it replaces")
    return new


def streaming_degree(events: DataFrame, lateness: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """(window, user_id, event_type, n) of an event stream; repeated event ids count once."""
    e = events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return e.groupBy(F.window("ts", window).alias("w"), "user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "user_id", "event_type", "n")
