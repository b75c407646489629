"""The business tables as a graph.

Keys become prefixed ids; foreign keys become facts.  A node's community is the
region it belongs to (parts are dealt over five); the return flag of a line tells how
certain its facts are, its quantity is their weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph, complete


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(key).cast("string"))


def relational_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read(spark, sf_dir, n)
    nation = t("nation")
    home = nation.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("long").alias("community"))

    def node(prefix, key, label, kind, table, community):
        return [_id(prefix, key).alias("id"), label.alias("label"), F.lit(kind).alias("node_type"), F.lit(table).alias("source_file"), community]

    region = t("region").select(*node("r", "r_regionkey", F.col("r_name"), "namespace", "region", F.col("r_regionkey").cast("long").alias("community")))
    nations = nation.select(*node("n", "n_nationkey", F.col("n_name"), "package", "nation", F.col("n_regionkey").cast("long").alias("community")))
    customer = t("customer").join(F.broadcast(home), F.col("c_nationkey") == F.col("k"), "left")  # 25 nations
    supplier = t("supplier").join(F.broadcast(home), F.col("s_nationkey") == F.col("k"), "left")
    of = customer.select(F.col("c_custkey").alias("cust"), "community")
    orders = t("orders").join(of, F.col("o_custkey") == F.col("cust"), "left")
    parts = [
        region,
        nations,
        customer.select(*node("c", "c_custkey", F.col("c_name"), "class", "customer", F.col("community"))),
        supplier.select(*node("s", "s_suppkey", F.col("s_name"), "interface", "supplier", F.col("community"))),
        t("part").select(*node("p", "p_partkey", F.col("p_name"), "struct", "part", (F.col("p_partkey") % 5).alias("community"))),
        orders.select(*node("o", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), "function", "orders", F.col("community"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return complete(out, NODE_SCHEMA)


def relational_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read(spark, sf_dir, n)
    sure, one = F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("weight")

    def edge(a, b, relation, table, confidence=sure, weight=one):
        return [a.alias("source"), b.alias("target"), F.lit(relation).alias("relation"), F.lit(table).alias("source_file"), confidence, weight]

    flag = F.when(F.col("l_returnflag") == "A", "EXTRACTED").when(F.col("l_returnflag") == "N", "INFERRED").otherwise("AMBIGUOUS").alias("confidence")
    quantity = F.col("l_quantity").alias("weight")
    line = t("lineitem")
    parts = [
        t("nation").select(*edge(_id("n", "n_nationkey"), _id("r", "n_regionkey"), "in_region", "nation")),
        t("customer").select(*edge(_id("c", "c_custkey"), _id("n", "c_nationkey"), "in_nation", "customer")),
        t("supplier").select(*edge(_id("s", "s_suppkey"), _id("n", "s_nationkey"), "in_nation", "supplier")),
        t("orders").select(*edge(_id("o", "o_orderkey"), _id("c", "o_custkey"), "placed_by", "orders")),
        line.select(*edge(_id("o", "l_orderkey"), _id("p", "l_partkey"), "contains", "lineitem", flag, quantity)),
        line.select(*edge(_id("p", "l_partkey"), _id("s", "l_suppkey"), "supplied_by", "lineitem", flag, quantity)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return complete(out, EDGE_SCHEMA)


def relational_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(relational_nodes(spark, sf_dir), relational_edges(spark, sf_dir))


def followed_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of kind ``calls`` from a part to the part of the next line of its order."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    e = line.withColumn("after", after).where("after is not null").select(_id("p", "l_partkey").alias("source"), _id("p", "after").alias("target")).distinct()
    return complete(e.withColumn("relation", F.lit("calls")), EDGE_SCHEMA)
