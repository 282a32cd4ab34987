"""Column functions and small table operators."""

from __future__ import annotations

from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Land-cover code -> ordinal fire risk (fixed values).
LANDCOVER_RISK = {
    111: 1, 112: 1, 121: 1, 122: 1, 124: 1, 131: 1, 133: 1, 142: 1,
    211: 2, 221: 2, 222: 2, 231: 2, 242: 2, 243: 2,
    311: 3, 312: 5, 313: 4, 321: 3, 322: 4, 324: 4, 331: 1, 332: 1, 333: 3, 335: 0,
    411: 0, 412: 0, 511: 0, 512: 0,
}
# Ten-class land cover -> ordinal fire risk (fixed values).
TEN_CLASS_RISK = {1: 1, 2: 2, 3: 3, 4: 4, 5: 3, 6: 5, 7: 4, 8: 1, 9: 0, 10: 0}
RISK_LABELS = ("No risk", "Very low", "Low", "Moderate", "High", "Very high")


def recode(code: Column, mapping: dict[int, int], default: int | str = 2, null_value: int | None = 0) -> Column:
    """Ordinal of a code; unmapped codes get ``default`` ("median": of the mapping's values), NULL ``null_value``."""
    other = int(median(mapping.values())) if default == "median" else default
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.when(code.isNull(), F.lit(null_value)).otherwise(F.coalesce(F.try_element_at(table, code), F.lit(other)))


def onehot(df: DataFrame, column: str, classes: list[int], prefix: str = "landcover") -> DataFrame:
    """0/1 columns ``<prefix>_<class>``; unknown classes give zeros everywhere."""
    return df.withColumns({f"{prefix}_{c}": F.coalesce((F.col(column) == c).cast("int"), F.lit(0)) for c in classes})


def update_features(df: DataFrame, column: str, method: str) -> DataFrame:
    """Replace a raw code column by its ordinal or one-hot form; no-op where it is absent."""
    if column not in df.columns:
        return df
    if method == "ordinal":
        return df.withColumn(f"{column}_risk", recode(F.col(column), TEN_CLASS_RISK, "median")).drop(column)
    return onehot(df, column, sorted(TEN_CLASS_RISK)).drop(column)


def unmapped_codes(df: DataFrame, column: str, mapping: dict[int, int]) -> DataFrame:
    """Codes of ``df`` that ``mapping`` lacks, with their row counts."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(mapping))).groupBy(column).agg(F.count("*").alias("n_rows"))


def out_of_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.agg(F.count_if(~F.col(column).between(low, high)).alias("n_outside"))


def assert_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """``df``, failing at run time on the first value outside [low, high]."""
    ok = F.coalesce(F.col(column).between(low, high), F.lit(True))
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.lit(f"{column} out of range"))))


def level_distribution(df: DataFrame, column: str, labels=RISK_LABELS) -> DataFrame:
    """Rows and percent per level, with its label."""
    names = F.array(*map(F.lit, labels))
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(
        column, "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"), F.get(names, F.col(column)).alias("label"))


def missing_profile(df: DataFrame, columns: list[str], limit: float = 10.0) -> DataFrame:
    """Percent missing per column, and whether it is above ``limit``."""
    shares = df.agg(*((F.avg(F.col(c).isNull().cast("int")) * 100).alias(c) for c in columns))
    return shares.unpivot([], columns, "feature", "missing_percent").withColumn("above_limit", F.col("missing_percent") > limit)


def prepare_events(df: DataFrame, date: str, start: str, lookback: int, last_year: int, x: str = "x", y: str = "y") -> DataFrame:
    """Events with a date, a point, a full look-back after ``start``, and a year up to ``last_year``."""
    day = F.to_date(F.col(date))
    return df.withColumn(date, day).where(
        day.isNotNull() & (day >= F.date_add(F.lit(start).cast("date"), lookback)) & (F.year(day) <= last_year) & F.col(x).isNotNull() & F.col(y).isNotNull())


def _tokens(name: Column, first: int, last: int, least: int) -> Column:
    parts = F.split(name, "_")
    return F.when(F.size(parts) >= least, F.array_join(F.slice(parts, first + 1, last - first + 1), "_"))


def ensemble_id(name: Column) -> Column:
    """Tokens 2 to 5 of a file name cut at underscores; NULL below six tokens."""
    return _tokens(name, 2, 5, 6)


def model_id(name: Column) -> Column:
    """Tokens 2 and 3."""
    return _tokens(name, 2, 3, 6)


def season(month: Column, kind: str = "meteorological") -> Column:
    if kind == "quarter":
        return F.element_at(F.array(*map(F.lit, ("Winter", "Spring", "Summer", "Fall"))), F.ceil(month / 3).cast("int"))
    return (F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring").when(month.isin(6, 7, 8), "Summer").when(month.isin(9, 10, 11), "Fall"))


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"))), month)


def pct_change(value: Column, base: Column, guard: str = "zero") -> Column:
    """Percent change; ``guard``: NULL at a zero base, a 0.001 offset, or a 1e-10 offset on absolutes."""
    if guard == "offset":
        return (value - base) / (base + F.lit(0.001)) * 100
    if guard == "absolute":
        return F.abs(value - base) / (F.abs(base) + F.lit(1e-10)) * 100
    return F.try_divide(value - base, base) * 100


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def prior_correct(p: Column, sample_rate: float, true_rate: float) -> Column:
    """Probability moved from the sample's base rate to the true one (offset of the intercept)."""
    return sigmoid(logit(p) + logit(F.lit(true_rate)) - logit(F.lit(sample_rate)))


def zone_names(df: DataFrame, candidates=("PLACE_IT", "NAME", "NAME_IT", "name"), key: str = "zone_id") -> DataFrame:
    """zone_name from the first candidate column that exists, else ``Zone_<id>``."""
    own = F.concat(F.lit("Zone_"), F.col(key).cast("string"))
    found = next((c for c in candidates if c in df.columns), None)
    return df.withColumn("zone_name", F.coalesce(F.col(found).cast("string"), own) if found else own)


def align_features(df: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """Features in the fitted order; an absent one is 0."""
    return df.select(*keep, *(F.col(c).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in order))


def fill_missing(df: DataFrame, columns: list[str], fill: str = "zero", means: dict[str, float] | None = None) -> DataFrame:
    """Missing features become 0, or with ``fill="mean"`` the column's mean: the fitted one of ``means``, else this table's."""
    if fill == "zero":
        return df.na.fill(0, columns)
    means = means or df.agg(*(F.avg(c).alias(c) for c in columns)).first().asDict()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c]).cast("double")) for c in columns})


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def empty_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    every = F.lit(True)
    for c in columns:
        every = every & F.col(c).isNull()
    return df.where(every)


def drop_extreme(df: DataFrame, column: str, tie: str, n: int = 1) -> DataFrame:
    """Without the ``n`` rows of least ``column`` (ties by ``tie``): a top-n of keys, then an anti join."""
    least = df.orderBy(F.col(column).asc_nulls_last(), tie).limit(n).select(tie)
    return df.join(F.broadcast(least), tie, "left_anti")  # n rows


def calendar_filter(df: DataFrame, date: str, months: list[int] | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    out = df
    if months:
        out = out.where(F.month(date).isin(months))
    return out.where(F.year(date).between(*years)) if years else out
