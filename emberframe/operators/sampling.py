"""Case-control sampling, deterministic on any partitioning: rows are ordered by md5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.operators.ranks import beside, numbered, offsets


def draw_order(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def replicate(df: DataFrame, n: int) -> DataFrame:
    """``n`` copies of each row; copy 0 is the presence (bin 1), the others are candidates."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("bin", (F.col("rep") == 0).cast("int"))


def random_date(df: DataFrame, low: str, high: str, seed: int, *keys: str) -> DataFrame:
    """``rand_date`` within [low, high], drawn by hash of the keys."""
    number = F.conv(F.substring(draw_order(seed, *keys), 1, 8), 16, 10).cast("long")
    lo, hi = F.lit(low).cast("date"), F.lit(high).cast("date")
    return df.withColumn("rand_date", F.date_add(lo, (number % (F.datediff(hi, lo) + 1)).cast("int")))


def exclude_period(candidates: DataFrame, presences: DataFrame, site: str, date: str, before: int = 60, after: int = 1825) -> DataFrame:
    """Candidates outside [presence - before, presence + after] of every presence at their site."""
    p = presences.select(F.col(site).alias("_site"), F.col("date").alias("_day"))
    clash = (F.col(site) == F.col("_site")) & (F.col(date) >= F.date_sub("_day", before)) & (F.col(date) <= F.date_add("_day", after))
    return candidates.join(p, clash, "left_anti")


def dealt_by_draw(df: DataFrame, group: list, seed: int, *keys: str) -> DataFrame:
    """``_d`` the draw, ``_b`` its first three hex digits, ``_o_n`` the group's rows in lower ``_b``."""
    dealt = df.withColumn("_d", draw_order(seed, *keys)).withColumn("_b", F.substring("_d", 1, 3))
    return beside(dealt, offsets(dealt, group, "_b", {"n": F.count("*")}), [*group, "_b"])


def draw_rank(group: list, *keys: str) -> Column:
    """Rank of a dealt row in its group; a task sorts a 4,096th of a group."""
    return F.col("_o_n") + F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_d", *keys))


def sample_per_group(df: DataFrame, group: list, n: int | str, seed: int, *keys: str) -> DataFrame:
    """``n`` rows (a number or a column) of each group without replacement."""
    limit = F.lit(n) if isinstance(n, int) else F.col(n)
    near = dealt_by_draw(df, group, seed, *keys).where(F.col("_o_n") < limit)  # buckets wholly beyond the cut go unranked
    return near.withColumn("_rn", draw_rank(group, *keys)).where(F.col("_rn") <= limit).drop("_rn", "_d", "_b", "_o_n")


def _cut(counts: DataFrame, bucket: str, n: Column) -> DataFrame:
    """One row (_cut, _before): the bucket in which the ``n``-th row falls, and the rows in lower ones; nulls if there are fewer."""
    upto = F.sum("_n").over(Window.orderBy(bucket))  # 65,536 rows at most
    return counts.withColumn("_upto", upto).agg(F.min(F.when(F.col("_upto") >= n, F.struct(F.col(bucket).alias("at"), (F.col("_upto") - F.col("_n")).alias("before")))).alias("_cut"))


def sample_rows(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows without replacement, or all there are: those of the ``n`` smallest draws, ties by ``keys``.

    The draw of the n-th row is found in two histograms, of its first 16 bits and of the next 16 where those
    agree; rows with smaller bits are taken as they are, and only rows that share all 32 with it
    are ranked. So no task sees the sample.
    """
    draw = draw_order(seed, *keys)
    bits = F.conv(F.substring(draw, 1, 8), 16, 10).cast("long")
    dealt = df.withColumns({"_d": draw, "_p": bits}).withColumn("_q", F.shiftright("_p", 16))
    high = F.broadcast(_cut(dealt.groupBy("_q").agg(F.count("*").alias("_n")), "_q", F.lit(n)))  # one row
    inside = dealt.crossJoin(high).where(F.col("_q") == F.col("_cut.at")).groupBy("_p", F.col("_cut.before").alias("_low")).agg(F.count("*").alias("_n"))
    low = inside.groupBy("_low").agg(F.collect_list(F.struct("_p", "_n")).alias("_all"))  # one row of 65,536 counts at most
    low = _cut(low.select("_low", F.inline("_all")), "_p", F.lit(n) - F.col("_low")).crossJoin(high.select(F.col("_cut.before").alias("_low")))
    told = dealt.crossJoin(F.broadcast(low)).withColumns({"_at": F.col("_cut.at"), "_room": F.lit(n) - F.col("_low") - F.col("_cut.before")}).drop("_cut", "_low")
    sure = told.where(F.col("_at").isNull() | (F.col("_p") < F.col("_at"))).select(*df.columns)
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_d", *keys))
    edge = told.where(F.col("_p") == F.col("_at")).withColumn("_rn", rank).where(F.col("_rn") <= F.col("_room")).select(*df.columns)
    return sure.unionByName(edge)


def number_from(df: DataFrame, start: int, *order: str) -> DataFrame:
    """Dense ids from ``start`` in the order of some columns; no task sees all rows."""
    return numbered(df, list(order), "new_id").withColumn("new_id", F.col("new_id") + (start - 1))


def dense_ids(df: DataFrame, first: str, *rest: str) -> DataFrame:
    """0-based ids in the order of ``first``, then ``rest``: numbers inside each value of ``first``, plus the rows of earlier ones.

    ``first`` should have few values beside the rows (a day, a zone): their counts are summed in one task.
    """
    sizes = df.groupBy(first).agg(F.count("*").alias("_n"))
    earlier = sizes.select(first, (F.sum("_n").over(Window.orderBy(first)) - F.col("_n")).alias("_before"))
    placed = beside(numbered(df, list(rest), "_rn", [first]), earlier, [first])
    return placed.withColumn("id_obs", F.col("_before") + F.col("_rn") - 1).drop("_rn", "_before")


def month_targets(presences: DataFrame, ratio: int) -> DataFrame:
    """Absences wanted per month: the month's share of presences times ``ratio`` times their number, half to even."""
    by_month = presences.groupBy(F.month("date").alias("mon")).agg(F.count("*").alias("n"))
    total = by_month.agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return by_month.crossJoin(F.broadcast(total)).select("mon", F.bround(share * ratio * F.col("total"), 0).cast("long").alias("target"))


def stratified_by_month(absences: DataFrame, presences: DataFrame, ratio: int, seed: int, key: str) -> DataFrame:
    """At most the month's target of absences, or all there are."""
    wanted = absences.withColumn("mon", F.month("date")).join(F.broadcast(month_targets(presences, ratio)), "mon")  # 12 rows
    return sample_per_group(wanted, ["mon"], "target", seed, key).drop("target")


def crosstab(df: DataFrame, row: Column, column: str, values: list) -> DataFrame:
    return df.groupBy(row.alias("row_key")).pivot(column, values).count().na.fill(0)


def train_test_split(df: DataFrame, label: str, share: float, seed: int, key: str) -> DataFrame:
    """``is_test`` for ceil(share * n) rows of each label, drawn by hash."""
    sizes = df.groupBy(label).agg(F.ceil(F.count("*") * share).alias("_take"))
    ranked = dealt_by_draw(df, [label], seed, key).join(F.broadcast(sizes), label)  # one row per label
    return ranked.withColumn("is_test", draw_rank([label], key) <= F.col("_take")).drop("_take", "_d", "_b", "_o_n")


def spacetime_folds(df: DataFrame, centres: list[tuple[float, float]], year_blocks: list[int]) -> DataFrame:
    """Fold = nearest of some spatial centres and the block of years; folds without a positive are left out."""
    gap = [(F.col("x") - cx) ** 2 + (F.col("y") - cy) ** 2 for cx, cy in centres]
    least = F.least(*gap) if len(gap) > 1 else gap[0]
    cluster = F.coalesce(*(F.when(g == least, F.lit(i)) for i, g in enumerate(gap)))
    block = sum(((F.year("date") >= y).cast("int") for y in year_blocks), F.lit(0))
    marked = df.withColumn("fold", F.concat_ws("-", cluster.cast("string"), block.cast("string")))
    good = marked.groupBy("fold").agg(F.sum("label").alias("_pos")).where("_pos > 0").select("fold")
    return marked.join(F.broadcast(good), "fold", "left_semi")  # one row per fold


def spatial_centres(df: DataFrame, k: int, seed: int) -> list[tuple[float, float]]:
    """Centres of ``k`` spatial clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=["x", "y"], outputCol="_xy").transform(df.select("x", "y"))
    return sorted(tuple(map(float, c)) for c in KMeans(k=k, seed=seed, featuresCol="_xy").fit(points).clusterCenters())


def thin(df: DataFrame, day: str, origin: str, n: int) -> DataFrame:
    """Every ``n``-th day from ``origin``."""
    return df.where(F.pmod(F.datediff(day, F.lit(origin).cast("date")), F.lit(n)) == 0)
