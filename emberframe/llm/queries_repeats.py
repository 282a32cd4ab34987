"""Query op9_repeats; its windows over whole tables have no practical SQL, so tests use brute force."""

from pyspark.sql import functions as F

from emberframe.llm.common import Scratch, table
from emberframe.llm.repeats import repeated, text_key, whole_characters


def op9_repeats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lost = repeated(docs, Scratch(spark)).select("th", "n", "n_removed", "n_spans", "kept")
    body = F.coalesce("text", F.lit("")).cast("binary")
    own = docs.select("doc_id", *(c.alias(k) for k, c in text_key().items()), body.alias("whole"))
    none = F.lit(0).cast("long")
    left = F.coalesce("kept", "whole")
    return own.join(lost, ["th", "n"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_bytes"), F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"), F.sha2(left, 256).alias("kept_sha256"), whole_characters(left).alias("text"))


QUERIES = {"op9_repeats": op9_repeats}
ORACLES: dict = {}
