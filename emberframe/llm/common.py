"""Shared folder, tables and connected components for the operators of this package."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def by_value(module: str) -> None:
    """Send functions of ``module`` to executors by value: they need no copy of this repository."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables in the folder that driver and executors share (``spark.checkpoint.dir``).

    A table written here cuts lineage and outlives the executors that wrote it. Where the setting is
    absent, a temporary folder takes its place in local mode, as in tests; a cluster has to name one.
    """

    def __init__(self, spark: SparkSession):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="emberframe-")
            spark.sparkContext.setCheckpointDir(root)
        self.spark, self.root = spark, f"{root.rstrip('/')}/emberframe-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lookup(rows: DataFrame, entries: DataFrame, on: list[str], heavy: Column) -> DataFrame:
    """Inner join of ``rows`` with ``entries``, which has one row per value of ``on``.

    ``heavy`` marks the entries that over a thousandth of all rows ask for: a thousand at most, so these
    are broadcast and their rows stay where they are. The rest is shuffled, and no key of it is hot.
    """
    hot = F.broadcast(entries.where(heavy))
    rest = rows.join(F.broadcast(entries.where(heavy).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(entries.where(~heavy).hint("shuffle_merge"), on))


def _are_stars(edges: DataFrame) -> bool:
    """Does every node of ``edges`` (u, v) have one edge to a smaller one at most, and none of its own besides?"""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return ends.where("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Smallest node id reachable from every node of ``edges`` (a long, b long).

    Alternates large-star and small-star contractions until only stars around the smallest nodes are left, which is
    told without a further round; each round is two aggregations and two joins, and its result is a table in the
    shared folder. Returns (node, component) for nodes that occur in an edge; self-loops are allowed.
    """
    cur = scratch.put(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{name}-0",
    )
    for step in range(1, 200):
        if _are_stars(cur):
            break
        # large star: link every larger neighbour to the smallest node of the neighbourhood
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: link every smaller neighbour, and the node itself, to the smallest one
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        cur = scratch.put(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        cur.select(F.col("v"), F.col("v"))
    ).distinct()
