"""Query op1_quality; a trained model has no SQL form, so tests measure held-out accuracy."""

from pyspark.sql import functions as F

from emberframe.llm.common import table
from emberframe.llm.quality import learn, score


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict = {}
