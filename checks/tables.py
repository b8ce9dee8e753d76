"""The test tables in the roles the queries use them in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kveil.operators.hierarchy import Hierarchy
from kveil.operators.project import select_typed
from kveil.session import ensure_checkpoint_dir
from kveil.sources.config import Roles, category, numeric

PERSON = Roles(quasi=(numeric("balance"), category("nation"), category("segment")))
ORDER = Roles(
    quasi=(numeric("price"), category("nation"), category("priority")),
    sensitive=(category("status"),),
    identifiers=(category("customer"),),
)
LINE = Roles(quasi=(numeric("quantity"), category("nation"), category("shipped")))
GROUP_ROWS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def chunk_label(id_col, rows: int = GROUP_ROWS):
    number = F.floor((id_col - 1) / rows) + 1
    return F.concat(F.lit("Cluster "), number.cast("string"))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, balance, nation, segment of every customer, and a cluster of five neighbours each."""
    people = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    people = people.select(
        (F.col("c_custkey") + 1).alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"),
        F.col("n_name").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    )
    return select_typed(people, PERSON.quasi, keep=["id", "name"]).withColumn("Cluster", chunk_label(F.col("id")))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, customer, price, nation, priority, status of every order."""
    orders = table(spark, sf_dir, "orders")
    home = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return orders.join(home, F.col("o_custkey") == F.col("c_custkey")).select(
        (F.col("o_orderkey") + 1).alias("id"),
        F.col("c_name").alias("customer"),
        F.col("o_totalprice").alias("price"),
        F.col("n_name").alias("nation"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quantity, supplier nation, ship year, flag and status of every line."""
    supply = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return table(spark, sf_dir, "lineitem").join(supply, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("n_name").alias("nation"),
        F.year("l_shipdate").cast("string").alias("shipped"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
    )


def geography(spark: SparkSession, sf_dir: str, attr: str = "nation") -> DataFrame:
    """Hierarchy rows: World, regions, nations."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    world = region.select(F.lit("World").alias("value"), F.lit("World").alias("parent"), F.lit(1).alias("level"))
    regions = region.select(F.col("r_name").alias("value"), F.lit("World").alias("parent"), F.lit(2).alias("level"))
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("value"), F.col("r_name").alias("parent"), F.lit(3).alias("level")
    )
    rows = world.distinct().unionByName(regions).unionByName(nations)
    return as_dgh(rows, attr)


def supplier_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geography with every supplier below its nation."""
    supply = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    rows = supply.select(F.col("s_name").alias("value"), F.col("n_name").alias("parent"), F.lit(4).alias("level"))
    return geography(spark, sf_dir, "supplier").unionByName(as_dgh(rows, "supplier"))


def flat(df: DataFrame, col: str, root: str, attr: str) -> DataFrame:
    """A two-level hierarchy of the values a column has."""
    leaves = df.select(F.col(col).alias("value")).distinct().select(
        "value", F.lit(root).alias("parent"), F.lit(2).alias("level")
    )
    top = leaves.select(F.lit(root).alias("value"), F.lit(root).alias("parent"), F.lit(1).alias("level"))
    return as_dgh(top.distinct().unionByName(leaves), attr)


def as_dgh(rows: DataFrame, attr: str) -> DataFrame:
    return rows.select(
        F.lit(attr).alias("attr"), "value", "parent", "level", F.lit(None).cast("string").alias("position")
    )


def person_hierarchy(spark: SparkSession, sf_dir: str) -> Hierarchy:
    segments = flat(table(spark, sf_dir, "customer"), "c_mktsegment", "Any segment", "segment")
    return Hierarchy.build(geography(spark, sf_dir).unionByName(segments))


def order_hierarchy(spark: SparkSession, sf_dir: str) -> Hierarchy:
    priorities = flat(table(spark, sf_dir, "orders"), "o_orderpriority", "Any priority", "priority")
    return Hierarchy.build(geography(spark, sf_dir).unionByName(priorities))
