"""Running sums, exact quantiles and ranks of large or skewed groups. No job runs while a plan is built, and no window sees a whole group."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINE = 20  #: bits by which a fine place is finer than a coarse one


def beside(df: DataFrame, extra: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, nulls being equal; ``extra`` has one row where ``on`` is empty."""
    if not on:
        return df.crossJoin(F.broadcast(extra))
    other = extra.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on))
    return df.join(other, same, how).drop(*(f"_on_{c}" for c in on))


def places(df: DataFrame, column: str) -> DataFrame:
    """``_f`` and ``_c``: a fine and a coarse place of each row's value, numbers that never fall as the value grows.

    They hang on the value alone, so all branches of a plan deal alike without looking at the data first.
    A number's fine place is its logarithm to 30 bits, so a coarse one spans a thousandth of the value and a
    fine one a thousand-millionth, which holds four million doubles at most; there are 1.5 million coarse
    places, and a million fine ones in each. A text's place is its first five bytes. NULL comes first, NaN last.
    """
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.StringType):
        code = F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 5)), 10, "0"), 16, 10).cast("long")
    else:
        v = F.unix_date(c).cast("double") if isinstance(kind, T.DateType) else c.cast("double")
        far = F.when(F.isnan(v), F.lit(1e9)).otherwise(F.signum(v) * F.log1p(F.least(F.abs(v), F.lit(1e299)) * float(1 << 30)))
        code = F.floor(far * float(1 << 30)).cast("long")
    code = F.coalesce(code, F.lit(-(1 << 62)))
    return df.withColumns({"_f": code, "_c": F.shiftright(code, FINE)})


def offsets(dealt: DataFrame, group: list[str], bucket: str, values: dict[str, Column], descending: bool = False) -> DataFrame:
    """(group, bucket, _o_<value>): sums over the group's buckets before each one. A group's buckets meet in one task."""
    totals = dealt.groupBy(*group, bucket).agg(*(v.alias(f"_t_{n}") for n, v in values.items()))
    upto = Window.partitionBy(*group).orderBy(F.desc(bucket) if descending else F.asc(bucket))
    return totals.select(*group, bucket, *((F.sum(f"_t_{n}").over(upto) - F.col(f"_t_{n}")).alias(f"_o_{n}") for n in values))


def before_places(dealt: DataFrame, group: list[str], values: dict[str, Column], descending: bool = False) -> DataFrame:
    """(group, _f, _o_<value>): sums over all lower fine places: those of the same coarse place, and the lower coarse ones."""
    fine = offsets(dealt, [*group, "_c"], "_f", values, descending)
    coarse = offsets(dealt, group, "_c", values, descending).withColumnsRenamed({f"_o_{n}": f"_a_{n}" for n in values})
    return beside(fine, coarse, [*group, "_c"]).select(*group, "_f", *((F.col(f"_o_{n}") + F.col(f"_a_{n}")).alias(f"_o_{n}") for n in values))


def running(by: DataFrame, order: str, values: list[str], descending: bool = False, group: list[str] | None = None, narrow: bool = False) -> DataFrame:
    """Running sums ``cum_<value>`` per group over rows of distinct ``order``.

    Sums run inside each fine place, and over the totals of fine and coarse ones; one join brings them together.
    ``narrow`` says that a group has one coarse place only, so fine ones are summed alone.
    """
    group = group or []
    dealt = places(by, order)
    inside = Window.partitionBy(*group, "_f").orderBy(F.desc(order) if descending else F.asc(order))
    summed = dealt.withColumns({f"_i_{v}": F.sum(v).over(inside) for v in values})
    before = (partial(offsets, bucket="_f") if narrow else before_places)(dealt, group, values={v: F.sum(v) for v in values}, descending=descending)
    summed = beside(summed, before, [*group, "_f"])
    return summed.select(*by.columns, *((F.col(f"_i_{v}") + F.col(f"_o_{v}")).alias(f"cum_{v}") for v in values))


def numbered(df: DataFrame, order: list[str], out: str, group: list[str] | None = None) -> DataFrame:
    """``df`` with 1-based numbers ``out`` per group in the order of some columns; rows equal in the first but for a thousand-millionth meet in one task."""
    group = group or []
    dealt = places(df, order[0])
    inside = F.row_number().over(Window.partitionBy(*group, "_f").orderBy(*order))
    placed = beside(dealt.withColumn("_rn", inside), before_places(dealt, group, {"n": F.count("*")}), [*group, "_f"])
    return placed.select(*df.columns, (F.col("_rn") + F.col("_o_n")).alias(out))


def exact_quantiles(df: DataFrame, value: str, shares: dict[str, float], group: list[str] | None = None) -> DataFrame:
    """One column per name of ``shares``: the interpolated quantile per group.

    Equals ``percentile``, without a task that holds all values of a group: rows are counted by coarse
    place, and only the values of places in which a wanted rank falls are then ranked. NULLs do not
    count; without a group, an empty table gives one row of NULLs.
    """
    group = group or []
    rows = places(df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("_v")), "_v").drop("_f").withColumnRenamed("_c", "_bin")
    counts = rows.groupBy(*group, "_bin").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    counts = counts.withColumns({"_upto": F.sum("_n").over(whole.orderBy("_bin")), "_all": F.sum("_n").over(whole)})
    at = {n: (F.col("_all") - 1) * F.lit(float(s)) for n, s in shares.items()}
    ranks = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(end).alias("end"), f(p).cast("long").alias("rank"), (p - F.floor(p)).alias("part"))
                      for n, p in at.items() for end, f in (("lo", F.floor), ("hi", F.ceil))))
    here = F.filter(ranks, lambda r: (r["rank"] >= F.col("_upto") - F.col("_n")) & (r["rank"] < F.col("_upto")))
    hits = counts.select(*group, "_bin", (F.col("_upto") - F.col("_n")).alias("_before"), F.explode(here).alias("_r"))
    near = beside(rows, hits.select(*group, "_bin").distinct(), [*group, "_bin"], "left_semi") if group else rows.join(F.broadcast(hits.select("_bin").distinct()), "_bin", "left_semi")  # two places a share
    values = near.groupBy(*group, "_bin", "_v").agg(F.count("*").alias("_n"))
    ranked = beside(running(values, "_v", ["_n"], group=[*group, "_bin"], narrow=True), hits, [*group, "_bin"])
    rank = F.col("_r.rank") - F.col("_before")
    found = ranked.where((rank >= F.col("cum__n") - F.col("_n")) & (rank < F.col("cum__n")))
    pick = lambda n, end: F.max(F.when((F.col("_r.name") == n) & (F.col("_r.end") == end), F.col("_v")))
    part = lambda n: F.max(F.when(F.col("_r.name") == n, F.col("_r.part")))
    parts = [c for n in shares for c in (pick(n, "lo").alias(f"_lo_{n}"), pick(n, "hi").alias(f"_hi_{n}"), part(n).alias(f"_f_{n}"))]
    mixed = [(F.col(f"_lo_{n}") * (1 - F.col(f"_f_{n}")) + F.col(f"_hi_{n}") * F.col(f"_f_{n}")).alias(n) for n in shares]
    return found.groupBy(*group).agg(*parts).select(*group, *mixed)
