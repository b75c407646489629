"""The graph model: typed nodes and directed facts held in DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The node types, confidence levels with default scores.
NODE_TYPES = (
    "class", "function", "module", "concept", "paper", "image", "file", "method",
    "interface", "enum", "struct", "trait", "constant", "variable", "package", "namespace",
)
CONFIDENCE = {"EXTRACTED": 1.0, "INFERRED": 0.7, "AMBIGUOUS": 0.4}

NODE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("label", T.StringType(), False),
        T.StructField("source_file", T.StringType(), False),
        T.StructField("source_location", T.StringType()),
        T.StructField("node_type", T.StringType(), False),
        T.StructField("community", T.LongType()),
        T.StructField("extra", T.StringType()),
        T.StructField("_ord", T.LongType()),
    ]
)
EDGE_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("target", T.StringType(), False),
        T.StructField("relation", T.StringType(), False),
        T.StructField("confidence", T.StringType(), False),
        T.StructField("confidence_score", T.DoubleType(), False),
        T.StructField("source_file", T.StringType(), False),
        T.StructField("source_location", T.StringType()),
        T.StructField("weight", T.DoubleType(), False),
        T.StructField("provenance", T.StringType()),
        T.StructField("extra", T.StringType()),
        T.StructField("_ord", T.LongType()),
    ]
)
HYPEREDGE_SCHEMA = "nodes array<string>, relation string, label string"


@dataclass(frozen=True)
class Graph:
    """Nodes, directed edges (parallel ones stay) and hyperedges."""

    nodes: DataFrame
    edges: DataFrame
    hyperedges: DataFrame | None = None

    def und(self) -> DataFrame:
        """(id, other, ...): every edge seen from both of its ends."""
        e = self.edges
        rest = [c for c in e.columns if c not in ("source", "target")]
        return e.select(F.col("source").alias("id"), F.col("target").alias("other"), *rest).unionAll(
            e.select(F.col("target").alias("id"), F.col("source").alias("other"), *rest)
        )

    def degree(self) -> DataFrame:
        """(id, degree) of every node, 0 where it has no edge; parallel edges count."""
        ends = self.edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        return self.nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def complete(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the columns of ``schema``, with defaults for those it lacks."""
    level = F.coalesce(F.col("confidence"), F.lit("EXTRACTED")) if "confidence" in df.columns else F.lit("EXTRACTED")
    score = F.lit(None).cast("double")
    for name, value in CONFIDENCE.items():
        score = F.when(level == name, F.lit(value)).otherwise(score)
    defaults: dict[str, Column] = {
        "node_type": F.lit("file"), "weight": F.lit(1.0), "confidence": F.lit("EXTRACTED"), "confidence_score": score, "source_file": F.lit(""),
        "label": F.col("id") if "id" in df.columns else F.lit(""),
    }
    out = []
    for f in schema.fields:
        default = defaults.get(f.name, F.lit(None))
        value = F.coalesce(F.col(f.name), default) if f.name in df.columns else default
        out.append(value.cast(f.dataType).alias(f.name))
    return df.select(*out)


def nodes_of(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Nodes from literal rows; arrival order is list order."""
    return _of(spark, rows, NODE_SCHEMA)


def edges_of(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return _of(spark, rows, EDGE_SCHEMA)


def _of(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    data = [tuple({"_ord": i, **r}.get(f.name) for f in schema.fields) for i, r in enumerate(rows)]
    return complete(spark.createDataFrame(data, loose), schema)
