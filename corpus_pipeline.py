"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

Stages read and return the columns of documents; others, of whatever names, do not reach the next stage. An
empty table gives an empty one. Null texts count as empty and stay null up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm import bpe, jaccard, mixing, quality, repeats, simhash
from emberframe.llm.common import Scratch, table
from emberframe.llm.queries_quality import held_out

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the passage-attention classifier predicts as label 1; the others go.

    Null and empty texts are scored as one passage without bytes; repeated rows get equal scores.
    """
    docs = docs.select(*COLUMNS)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.learn(docs, labels, held_out())
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest doc_id.

    SimHash fingerprints of the sets of five-word shingles, within 2 bits by multi-index hashing, give the first
    links; an exact check keeps those of similarity 0.8 or more. No SimHash radius of bounded cost holds all such
    pairs, so texts that are not linked yet also meet in prefix lists, which lose none. Null and
    empty texts are one group. A null doc_id stays only if its group has no other; of rows equal in doc_id and
    text, one stays.
    """
    docs = docs.select(*COLUMNS)
    scratch = Scratch(spark)
    return simhash.keep_first(docs, jaccard.near_duplicates(docs, scratch), scratch).select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their passages of over 50 words that occur elsewhere too; n_chars follows the text.

    Such a passage has 101 bytes at least, so all of it lies in repeated strings of that length.
    Repeated rows repeat their passages, so texts of over 50 words that come twice become empty.
    """
    out = repeats.strip_repeats(docs.select(*COLUMNS), Scratch(spark), length=101, min_words=51)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; null is a source of its own, rows of one id and text are told apart."""
    return mixing.repeat_rows(mixing.mix(docs.select(*COLUMNS), Scratch(spark))).select(*COLUMNS)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text decoded from them; a null text becomes an empty one."""
    out = bpe.encode_texts(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.col("decoded").cast("string").alias("text"), "lang", "source", "n_chars", "n_tokens", "ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_sources", mix_sources),
    ("byte_level_bpe", byte_level_bpe),
]

#: Training, hashing and merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
