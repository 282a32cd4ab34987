"""The roles of the risk model played by the star tables, as DataFrames and as SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EV = "ev AS (SELECT o_orderkey AS id_obs, o_custkey AS site_id, CAST(o_orderdate AS DATE) AS date, CAST((o_orderkey * 7919) % 1000 AS DOUBLE) AS x, CAST((o_orderkey * 104729) % 1000 AS DOUBLE) AS y FROM orders)"
# One cell of side 10 a part: the grid is 100 cells wide and as high as the table is long.
CELLS = "cells AS (SELECT CAST(p_partkey % 100 AS INT) AS ix, CAST(p_partkey // 100 AS INT) AS iy, avg(p_retailprice) AS v, max(p_size) AS code, (CAST(p_partkey % 100 AS INT) + 0.5::DOUBLE) * 10 AS x, (CAST(p_partkey // 100 AS INT) + 0.5::DOUBLE) * 10 AS y FROM part GROUP BY ALL)"
CLIM = "clim AS (SELECT l_suppkey AS loc, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS T, avg(l_extendedprice) / 1000 AS P FROM lineitem GROUP BY 1, 2)"
ENS = "ens AS (SELECT l_returnflag AS scenario, l_linestatus AS variable, l_suppkey AS member, l_partkey % 20 AS cell, CAST(l_shipdate AS DATE) AS day, l_quantity AS value FROM lineitem)"
FACT = "fact AS (SELECT s_nationkey AS zone_id, n_name AS zone_name, l_suppkey AS member, l_returnflag AS scenario, CAST(year(l_shipdate) AS INT) AS yr, CAST(month(l_shipdate) AS INT) AS mon, l_discount AS risk FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"
PRED = "pred AS (SELECT d.doc_id, CAST(quality AS INT) AS label, CAST(n_chars AS DOUBLE) / (SELECT max(n_chars) FROM documents) AS score, CAST((d.doc_id * 7919) % 1000 AS DOUBLE) / 1000 AS score2, CAST(DATE '2020-01-01' + CAST(d.doc_id % 1461 AS INT) AS DATE) AS date FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
SEASON = "CASE WHEN {0} IN (12, 1, 2) THEN 'Winter' WHEN {0} IN (3, 4, 5) THEN 'Spring' WHEN {0} IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END"

# Zones on a 1000 x 1000 plane: a square, a triangle, a square with a hole that turns as its shell does, an L, and
# two parts, of which one has a hole with an island in it.
ZONES = [
    (1, [[(0, 0), (400, 0), (400, 400), (0, 400)]]),
    (2, [[(500, 0), (1000, 0), (1000, 500)]]),
    (3, [[(0, 500), (450, 500), (450, 1000), (0, 1000)], [(100, 600), (300, 600), (300, 800), (100, 800)]]),
    (4, [[(500, 600), (1000, 600), (1000, 700), (600, 700), (600, 1000), (500, 1000)]]),
    (5, [[(650, 750), (750, 750), (750, 850), (650, 850)], [(800, 720), (950, 720), (950, 950), (800, 950)],
         [(820, 740), (820, 930), (930, 930), (930, 740)], [(850, 800), (900, 800), (900, 850), (850, 850)]]),
]


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def shared_folder(spark, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, in a temporary folder, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="emberframe-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def events(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id_obs"), F.col("o_custkey").alias("site_id"), F.to_date("o_orderdate").alias("date"),
        (F.col("o_orderkey") * 7919 % 1000).cast("double").alias("x"), (F.col("o_orderkey") * 104729 % 1000).cast("double").alias("y"))


def cells(spark, d) -> DataFrame:
    ix, iy = (F.col("p_partkey") % 100).cast("int"), F.expr("p_partkey div 100").cast("int")
    got = table(spark, d, "part").groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.avg("p_retailprice").alias("v"), F.max("p_size").alias("code"))
    return got.withColumns({"x": (F.col("ix") + 0.5) * 10, "y": (F.col("iy") + 0.5) * 10})


def climate(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("loc"), F.to_date("l_shipdate").alias("day")).agg(
        F.avg("l_quantity").alias("T"), (F.avg("l_extendedprice") / 1000).alias("P"))


def ensemble(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("scenario"), F.col("l_linestatus").alias("variable"), F.col("l_suppkey").alias("member"),
        (F.col("l_partkey") % 20).alias("cell"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("value"))


def fact(spark, d) -> DataFrame:
    li, su, na = (table(spark, d, t) for t in ("lineitem", "supplier", "nation"))
    return li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).join(na, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_nationkey").alias("zone_id"), F.col("n_name").alias("zone_name"), F.col("l_suppkey").alias("member"), F.col("l_returnflag").alias("scenario"),
        F.year("l_shipdate").alias("yr"), F.month("l_shipdate").alias("mon"), F.col("l_discount").alias("risk"))


def predictions(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    top = docs.agg(F.max("n_chars").alias("_top"))
    both = table(spark, d, "labels").select("doc_id", "quality").join(docs, "doc_id").crossJoin(F.broadcast(top))  # one row
    return both.select(
        "doc_id", F.col("quality").cast("int").alias("label"), (F.col("n_chars").cast("double") / F.col("_top")).alias("score"),
        ((F.col("doc_id") * 7919 % 1000).cast("double") / 1000).alias("score2"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1461).cast("int")).alias("date"))


def zones(spark) -> DataFrame:
    rows = [(z, [[(float(x), float(y)) for x, y in r] for r in rings]) for z, rings in ZONES]
    return spark.createDataFrame(rows, "zone_id int, rings array<array<struct<x:double,y:double>>>")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, so that the order of summation does not show."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
