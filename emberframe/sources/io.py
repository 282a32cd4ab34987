"""Sources and sinks: gridded tables, daily series, vector layers, ensembles, results and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN becomes NULL, once, at ingest: aggregates then skip missing values."""
    kinds = dict(df.dtypes)
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns))


def read_cells(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """Long static cells (iy, ix, x, y, variable, value) as one row per cell, a column per variable."""
    long = nan_to_null(spark.read.parquet(path)).where(F.col("variable").isin(variables))
    return widen_cells(long, variables)


def widen_cells(long: DataFrame, variables: list[str]) -> DataFrame:
    return long.groupBy("iy", "ix").pivot("variable", variables).agg(F.first("value", ignorenulls=True))


def read_climate(spark: SparkSession, path: str, variable: str, day_lo: str, day_hi: str) -> DataFrame:
    """Daily grid of one variable; the day range prunes partitions (variable, year, month) and row groups."""
    lo, hi = F.lit(day_lo).cast("date"), F.lit(day_hi).cast("date")
    month = F.col("year") * 12 + F.col("month")
    return spark.read.parquet(path).where(
        (F.col("variable") == variable) & F.col("day").between(lo, hi)
        & month.between(F.year(lo) * 12 + F.month(lo), F.year(hi) * 12 + F.month(hi)))


def touched_months(events: DataFrame, date: str = "date", days: int = 60) -> DataFrame:
    """(year, month) of every month in which a look-back of ``days`` from an event has a day; a calendar's months at most."""
    first = F.trunc(F.date_sub(date, days - 1), "month")
    start = events.select(date).where(F.col(date).isNotNull()).distinct().select(F.explode(F.sequence(first, F.trunc(date, "month"), F.expr("INTERVAL 1 MONTH"))).alias("_start"))
    return start.select(F.year("_start").alias("year"), F.month("_start").alias("month")).distinct().where(F.col("month").between(1, 12))


def read_climate_for(spark: SparkSession, path: str, variable: str, events: DataFrame, date: str = "date", days: int = 60) -> DataFrame:
    """Daily grid of one variable, of the months that the events' look-backs touch: other folders are not opened.

    The months are found while the query runs, from the events, and prune the partitions (variable, year, month);
    as one number each, since year and month by themselves would keep every pairing of the two.
    """
    months = F.broadcast(touched_months(events, date, days).select((F.col("year") * 12 + F.col("month")).alias("_at")))  # a calendar's months
    grid = spark.read.parquet(path).where(F.col("variable") == variable)
    return grid.join(months, grid["year"] * 12 + grid["month"] == months["_at"], "left_semi")


def write_climate(df: DataFrame, path: str) -> None:
    """Daily grids in folders (variable, year, month). Rows are dealt by folder in parts of a size that Spark bounds, so a task sorts no more as the grid grows."""
    dated = df.withColumn("year", F.year("day")).withColumn("month", F.month("day"))
    dated.hint("rebalance", "variable", "year", "month").write.mode("overwrite").partitionBy("variable", "year", "month").parquet(path)


def asof_nearest_day(keys: DataFrame, series: DataFrame, by: str = "loc") -> DataFrame:
    """For each (by, day) of ``keys``, the row of ``series`` at the nearest day; ties go to the earlier day.

    Each side of the series is reached by one sorted pass over the union of both tables, the later one by a pass back
    from the last day, as a frame that reaches ahead is read anew for every row. Places that are not asked for leave first.
    """
    asked = keys.select(by, "day").distinct()
    known = series.join(asked.select(by).distinct(), by, "left_semi")
    known = known.select(by, "day", F.struct(*[c for c in series.columns if c != by]).alias("at"), F.lit(None).cast("struct<q:int>").alias("q"))
    asked = asked.select(by, "day", F.lit(None).cast(known.schema["at"].dataType).alias("at"), F.struct(F.lit(1).alias("q")).alias("q"))
    w = Window.partitionBy(by)
    seen = lambda order: F.last("at", ignorenulls=True).over(w.orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    both = known.unionByName(asked).withColumns({"before": seen(F.asc("day")), "after": seen(F.desc("day"))}).where("q is not null")
    gap = lambda c: F.abs(F.datediff(F.col(f"{c}.day"), "day"))
    near = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull() | (gap("before") <= gap("after")), F.col("before")).otherwise(F.col("after"))
    return both.select(by, "day", near.alias("at")).select(by, "day", *(F.col(f"at.{c}").alias("nearest_day" if c == "day" else c) for c in series.columns if c != by))


def read_daily_files(spark: SparkSession, glob: str, pattern: str = r"(\d{8})") -> DataFrame:
    """Daily files named by date: the day is parsed from each file's name."""
    name = F.col("_metadata.file_name")
    return spark.read.parquet(glob).withColumn("day", F.to_date(F.regexp_extract(name, pattern, 1), "yyyyMMdd"))


def with_absent_zero(grid: DataFrame, daily: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """Left join; a day without a file, or a cell without a value, counts as 0."""
    return grid.join(daily, on, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Polygon and MultiPolygon features of a GeoJSON file as (zone_id, properties, rings); a zone has the rings of all its parts."""
    feature = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    raw = spark.read.schema(f"features array<{feature}>").option("multiLine", True).json(path)
    f = raw.select(F.posexplode("features").alias("pos", "f"))
    ring_list = "array<array<array<double>>>"
    parsed = F.when(F.col("f.geometry.type") == "MultiPolygon", F.flatten(F.from_json("f.geometry.coordinates", f"array<{ring_list}>"))).otherwise(
        F.from_json("f.geometry.coordinates", ring_list))
    rings = F.transform(parsed, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return f.select((F.col("pos") + 1).alias("zone_id"), F.col("f.properties").alias("properties"), rings.alias("rings"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def write_events(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return nan_to_null(spark.read.schema(schema).csv(path, header=True))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_ensemble(spark: SparkSession, root: str, skip_bad: bool = True) -> DataFrame:
    """All member files under ``root``, unreadable or vanished ones skipped, with member and model ids."""
    from emberframe.functions.scalar import ensemble_id, model_id

    reader = spark.read.option("recursiveFileLookup", True)
    if skip_bad:
        reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    name = F.col("_metadata.file_name")
    return reader.parquet(root).withColumns({"member": ensemble_id(name), "model": model_id(name)})


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_file(df: DataFrame, path: str) -> None:
    """Write a small table as one file of the given name: through a folder beside it, then by a rename."""
    df.coalesce(1).write.mode("overwrite").parquet(f"{path}.tmp")
    (folder, fs), (to, _) = _at(df.sparkSession, f"{path}.tmp"), _at(df.sparkSession, path)
    part = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    fs.delete(to, True)
    if not fs.rename(part, to):
        raise OSError(f"cannot rename to {path}")
    fs.delete(folder, True)


def cut_file(spark: SparkSession, path: str, size: int) -> None:
    """Leave only the first bytes of a file, as a broken copy does."""
    at, fs = _at(spark, path)
    with_bytes = fs.open(at)
    data = bytes(with_bytes.readNBytes(size))
    with_bytes.close()
    out = fs.create(at, True)
    out.write(data)
    out.close()


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def write_once(df: DataFrame, path: str) -> bool:
    """Write unless a whole output is there already, and say whether it did; what a job that died has left is overwritten."""
    if exists(df.sparkSession, f"{path}/_SUCCESS"):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def pair_versions(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys of either version with both values and which side is missing."""
    a, b = old.select(*keys, F.col(value).alias("old_value"), F.lit(1).alias("_o")), new.select(*keys, F.col(value).alias("new_value"), F.lit(1).alias("_n"))
    side = F.when(F.col("_o").isNull(), "OLD_MISSING").when(F.col("_n").isNull(), "NEW_MISSING").otherwise("BOTH")
    return a.join(b, keys, "full_outer").select(*keys, "old_value", "new_value", side.alias("side"))


def union_scenarios(frames: dict[str, DataFrame], tag: str = "scenario") -> DataFrame:
    out = None
    for name, df in frames.items():
        tagged = df.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out
