"""Query op3_ctw; the model has no SQL form, so tests compare with a plain context tree."""

from pyspark.sql import functions as F

from emberframe.llm.common import Scratch, table
from emberframe.llm.ctw import score


def op3_ctw(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scored = score(docs, ~held, Scratch(spark))
    return scored.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


QUERIES = {"op3_ctw": op3_ctw}
ORACLES: dict = {}
