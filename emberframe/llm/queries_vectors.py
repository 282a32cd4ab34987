"""Queries op2_pq and op10_ann; their indexes have no SQL form, so tests measure against brute force."""

from pyspark.sql import functions as F

from emberframe.llm.ann import search_inner
from emberframe.llm.common import Scratch, table
from emberframe.llm.pq import near_vectors


def op2_pq(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), Scratch(spark))


def op10_ann(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search_inner(vectors, F.col("vec_id") % 20 == 0, Scratch(spark))


QUERIES = {"op2_pq": op2_pq, "op10_ann": op10_ann}
ORACLES: dict = {}
