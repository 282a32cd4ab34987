"""Query op5_sharding; its boundaries come from a search that SQL cannot express."""

from pyspark.sql import functions as F

from emberframe.llm.common import Scratch, table
from emberframe.llm.sharding import shard_by_bytes


def op5_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return shard_by_bytes(docs, Scratch(spark)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_sharding": op5_sharding}
ORACLES: dict = {}
