"""Query op6_simhash; XXH64 shingles have no SQL form, so tests compare with brute force."""

from pyspark.sql import functions as F

from emberframe.llm.common import Scratch, table
from emberframe.llm.simhash import near_duplicates


def op6_simhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, Scratch(spark)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
ORACLES: dict = {}
