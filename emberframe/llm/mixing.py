"""Mixing sources to target weights by capped water-filling (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.common import WORD, Scratch

BIN_DIGITS = 3


def word_count(text="text"):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def draw_key(seed: int):
    """Fixed pseudo-random order of documents; only rows of equal doc_id and text share a key."""
    id_, text = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), id_, F.lit(":"), F.md5(text)))


def source_plan(sized: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """One row per source of ``sized`` (source, size, key): its target, whole repetitions and cut key.

    Sources in code point order (null last) weigh ``weights`` in turn and share the sum of all
    sizes. Targets above ``max_epochs`` times the source's size are clamped there and the excess is
    shared by weight among the rest, until none is above. A document is taken ``whole`` times, and
    once more if its key is below ``cut``, the key at which the running size of the source's
    documents in key order reaches the fractional rest; of the ``tied`` rows of that key, as many
    (``some``) as come nearest to it. The running size is taken over hashed bins, then inside the
    single bin where it crosses, so no source lands in one task.
    A source of size 0, or a table without rows, has target 0 or no row.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    sources = sources.select(
        "source", "source_size", (F.lit(max_epochs) * F.col("source_size")).alias("cap"),
        F.element_at(F.array(*map(F.lit, weights)), turn + 1).alias("weight"),
    ).persist()
    level, capped = 0.0, None
    while True:
        over = (F.col("cap") == 0) if capped is None else (F.col("cap") == 0) | (F.col("weight") * F.lit(level) > F.col("cap"))
        total, caps, rest, n = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)), F.count_if(over),
        ).first()
        if n == capped:
            break
        level, capped = (total - caps) / rest if rest else float(max(total, 1)) * max_epochs, n
    plan = sources.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double")))
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    plan = plan.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))

    bins = sized.groupBy("source", F.substring("key", 1, BIN_DIGITS).alias("bin")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin")) - F.col("words")
    same = F.col("b.source").eqNullSafe(F.col("p.source"))
    edge = (
        bins.withColumn("before", upto).alias("b").join(plan.alias("p"), same)
        .where(F.col("before") <= F.col("part"))
        .groupBy("p.source").agg(F.max_by(F.struct("bin", "before", "part"), "bin").alias("e")).select("source", "e.*")
    )
    inside = sized.withColumn("bin", F.substring("key", 1, BIN_DIGITS)).alias("b").join(
        edge.alias("p"), same & (F.col("b.bin") == F.col("p.bin"))
    ).select("b.source", "b.key", "b.size", "p.before", "p.part")
    ties = inside.groupBy("source", "key", "before", "part").agg(F.count("*").alias("tied"), F.first("size").alias("size"))
    upto = F.col("before") + F.sum(F.col("tied") * F.col("size")).over(Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    reached = ties.withColumn("upto", upto).where(F.col("upto") >= F.col("part"))
    lacks = F.try_divide(F.col("part") - F.col("upto") + F.col("tied") * F.col("size"), "size")
    some = F.coalesce(F.floor(lacks + 0.5), F.lit(0))
    cuts = reached.groupBy("source").agg(F.min_by(F.struct("key", some.alias("some"), "tied"), "key").alias("c"))
    return plan.alias("b").join(cuts.alias("p"), same).select(
        "b.source", "source_size", "target", "whole", F.col("c.key").alias("cut"), F.col("c.some").alias("some"), F.col("c.tied").alias("tied"))


def mix(docs: DataFrame, scratch: Scratch, weights=(5, 2, 1), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """Add size, source_size, target, whole and copies (how often the mix takes the row) to ``docs``.

    Null texts have size 0 and null sources form one source. Rows of equal doc_id and text are told
    apart only where a source's cut falls among them. Reruns give the same rows. Existing columns of
    the added names are replaced, no others are touched.
    """
    added = ("size", "source_size", "target", "whole", "copies")
    docs = docs.drop(*added)
    sized = docs.select("source", word_count().alias("size"), draw_key(seed).alias("key"))
    plan = scratch.put(source_plan(scratch.put(sized, "sized"), weights, max_epochs), "plan")
    out = docs.select(F.struct("*").alias("row"), F.col("source").alias("s"), word_count().alias("size"), draw_key(seed).alias("key"))
    out = out.join(plan.withColumnRenamed("source", "p"), F.col("s").eqNullSafe(F.col("p")))
    more = F.when(F.col("key") < F.col("cut"), 1).when(F.col("key") == F.col("cut"), F.least("some", F.lit(1))).otherwise(0)
    if plan.where("tied > 1").isEmpty():
        out = out.withColumn("more", more)
    else:  # of equal rows at the cut, some are taken
        tie = (F.col("key") == F.col("cut")) & (F.col("tied") > 1)
        turn = F.row_number().over(Window.partitionBy("s", "key").orderBy(F.xxhash64("row")))
        out = out.where(~tie).withColumn("more", more).unionByName(out.where(tie).withColumn("more", (turn <= F.col("some")).cast("int")))
    return out.withColumn("copies", (F.col("whole") + F.col("more")).cast("long")).select(
        *(F.col("row").getField(c).alias(c) for c in docs.columns), *added)


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Every row of ``mix`` as many times as the mix takes it."""
    each = mixed.where("copies > 0").select(F.struct("*").alias("row"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("row.*")
