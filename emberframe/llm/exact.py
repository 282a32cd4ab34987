"""Exact duplicates by a persistent index of text digests, bucketed and sorted by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm.common import Scratch, lookup


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, digest, uid) of every row: the SHA-256 of the text's UTF-8 bytes, null counting as empty.

    ``uid`` tells rows of equal ids apart. It is drawn from the place of a row, so write the table once.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("digest"), F.monotonically_increasing_id().alias("uid"))


class DigestIndex:
    """A table (digest, doc_id) at ``path``, in ``buckets`` by the digest's hash and sorted by digest.

    A digest's document is the one of largest doc_id that was ever added, null being the least. Adding
    shuffles the new rows only, one per distinct text: the index is read by bucket. Every addition
    appends; an id that a later batch raises is a further row of its digest, and readers take the largest.
    So adding a batch twice, or again after a job that died, changes nothing. The folder outlives the
    session; a later one opens it by the same path and number of buckets. At 40 bytes a text, choose
    buckets of a few hundred MB.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int, id_type: str = "bigint"):
        self.spark, self.path, self.name, self.buckets = spark, path, name, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest binary, doc_id {id_type}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def entries(self) -> DataFrame:
        """(digest, keep_id), one row per text; no shuffle, since buckets hold whole digests."""
        return self.rows().groupBy("digest").agg(F.max("doc_id").alias("keep_id"))

    def missing(self, batch: DataFrame) -> DataFrame:
        """(digest, doc_id) of the texts of ``batch`` that the index lacks, or has under a smaller id only."""
        new = batch.groupBy("digest").agg(F.max("doc_id").alias("doc_id")).alias("n")
        known = self.rows().alias("k").hint("merge")
        same = (F.col("n.digest") == F.col("k.digest")) & (F.col("n.doc_id").isNull() | (F.col("k.doc_id") >= F.col("n.doc_id")))
        return new.join(known, same, "left_anti")

    def add(self, batch: DataFrame) -> None:
        """Append what ``missing`` finds, one file per bucket."""
        self.missing(batch).select("digest", "doc_id").repartition(self.buckets, "digest").write.insertInto(self.name)

    def compact(self, path: str, name: str) -> DigestIndex:
        """The same index at another path, one row per digest and one file per bucket."""
        out = DigestIndex(self.spark, path, name, self.buckets, self.rows().schema["doc_id"].dataType.simpleString())
        self.entries().select("digest", F.col("keep_id").alias("doc_id")).repartition(self.buckets, "digest").write.insertInto(name, overwrite=True)
        return out

    def forget(self) -> None:
        """Drop the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def label(rows: DataFrame, index: DigestIndex, scratch: Scratch) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of every row of ``rows`` (doc_id, digest, uid), all of which ``index`` holds.

    keep_id is the index's document of the text, which may lie outside ``rows``; group_size counts the
    rows of ``rows`` with the text; kept is true for one row of that id, whatever repeats it. Rows of
    null ids are kept only where all rows of a text have none. Groups are counted before the shuffle, and
    rows of texts that over a thousandth of them share meet their group by broadcast.
    """
    first = F.max(F.struct("doc_id", F.negate("uid").alias("turn")))  # of equal ids, the least uid
    groups = rows.groupBy("digest").agg(F.count("*").alias("group_size"), first.alias("first"))
    groups = scratch.put(groups.join(index.entries(), "digest").select("digest", "keep_id", "group_size", F.col("first.turn").alias("turn")), "groups")
    found = lookup(rows, groups, ["digest"], F.col("group_size") > F.lit(rows.count() / 1000))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.negate("uid") == F.col("turn"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def drop_duplicates(docs: DataFrame, index: DigestIndex, scratch: Scratch) -> DataFrame:
    """Add ``docs`` to ``index`` and return, of each of their texts, the one row that stays, with all its columns.

    A text whose document lies in an earlier batch has no row here. Columns of any name pass through.
    """
    packed = scratch.put(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("uid")), "packed")
    body = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = scratch.put(packed.select(F.col("row.doc_id").alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("digest"), "uid"), "digests")
    index.add(rows)
    first = F.max(F.struct("doc_id", F.negate("uid").alias("turn")))
    groups = rows.groupBy("digest").agg(first.alias("first")).join(index.entries(), "digest")
    stays = groups.where(F.col("first.doc_id").eqNullSafe(F.col("keep_id"))).select(F.negate("first.turn").alias("uid"))
    return packed.join(stays, "uid", "left_semi").select("row.*")
