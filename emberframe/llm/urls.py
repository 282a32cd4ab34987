"""URL filters: longest matching rule, else gradient-boosted trees on lexical features (JVM only)."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import Scratch, lookup

FEATURES = (
    "url_len", "host_len", "path_len", "depth", "labels", "digit_ratio", "hyphens", "entropy", "params", "query_len",
    "fragment", "secure", "www", "ends_slash", "has_ext", "first_len", "suffix_len", "suffix_log_count", "suffix_share", "suffix_block",
)


def host_and_path(url):
    """(host, path) columns: host lower-cased in A-Z only; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(rules):
    """(rule, verdict) columns of the longest of ``rules`` [(verdict, 'host/path')] that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(f"/{path}"))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def _count(column, pattern):
    return F.regexp_count(column, F.lit(pattern)).cast("double")


def lexical(pages: DataFrame) -> DataFrame:
    """Lexical features of (url, host, path), and the registrable suffix (last two host labels)."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url).cast("double")
    chars = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return pages.withColumns({
        "url_len": n, "host_len": F.length("host").cast("double"), "path_len": F.length("path").cast("double"),
        "depth": _count(F.col("path"), "/[^/]+"), "labels": _count(F.col("host"), r"[^.]+"),
        "digit_ratio": F.coalesce(F.try_divide(_count(url, "[0-9]"), n), F.lit(0.0)), "hyphens": _count(url, "-"),
        "entropy": entropy, "params": _count(query, "[^&=]+="), "query_len": F.length(query).cast("double"),
        "fragment": F.contains(url, F.lit("#")).cast("double"), "secure": F.startswith(url, F.lit("https")).cast("double"),
        "www": F.startswith("host", F.lit("www.")).cast("double"), "ends_slash": F.endswith("path", F.lit("/")).cast("double"),
        "has_ext": F.col("path").rlike(r"\.[a-z]{2,5}$").cast("double"),
        "first_len": F.length(F.regexp_extract("path", "^/([^/]*)", 1)).cast("double"),
        "suffix": F.substring_index("host", ".", -2),
        "suffix_len": F.length(F.substring_index("host", ".", -1)).cast("double"),
    })


def fold(seed: int):
    """0 to 9 for each url: 0 to 3 give suffix statistics, 4 to 8 train, 9 is held out."""
    return F.pmod(F.xxhash64(F.lit(seed + 1), F.coalesce("url", F.lit(""))), F.lit(10))


def judge(pages: DataFrame, scratch: Scratch, rules, sample: int = 20_000, trees: int = 20, depth: int = 4, seed: int = 5) -> DataFrame:
    """Add host, path, rule, verdict and score (the trees' probability of block) to ``pages``.

    The longest fitting rule decides. Urls under a rule are the labelled ones, dealt by a hash of the url (see
    ``fold``): four tenths give the suffixes' shares of labelled and blocked urls, a bounded sample of at most about
    ``sample`` of five tenths trains the trees, which decide all urls without a rule, and one tenth is held
    out from both. So no feature knows the label of a url that trains or tests. Counts of a suffix are over
    all rows. Null and empty urls have empty host and path and are judged like any other. Without
    urls to train on of both verdicts, the only verdict seen, or else allow, is given. Existing columns
    of the added names are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "score")
    host, path = host_and_path(F.col("url"))
    name, said = longest_rule(rules)
    base = pages.select(F.struct("*").alias("row"), F.col("url").alias("url")).withColumns({"host": host, "path": path}).withColumns({"rule": name, "said": said})
    suffix = F.substring_index("host", ".", -2)
    told = F.when(fold(seed) < 4, F.col("said"))
    stats = scratch.put(
        base.groupBy(suffix.alias("suffix")).agg(
            F.count("*").alias("_n"), F.count(told).alias("_labelled"), F.count_if(told == "block").alias("_blocked"),
            F.count_if(F.col("said").isNotNull() & fold(seed).between(4, 8)).alias("_train"), F.count_if((F.col("said") == "block") & fold(seed).between(4, 8)).alias("_bad")),
        "suffixes")
    rows, labelled, blocked = stats.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("_n", "_train", "_bad"))).first()
    ready = lookup(lexical(base), stats, ["suffix"], F.col("_n") > rows / 1000).withColumns({
        "suffix_log_count": F.log1p("_n"), "suffix_share": F.col("_labelled") / F.col("_n"),
        "suffix_block": (F.col("_blocked") + F.lit(0.5)) / (F.col("_labelled") + F.lit(1.0)),
    })
    out = [*(F.col("row").getField(c).alias(c) for c in pages.columns), "host", "path", "rule"]
    if 0 < blocked < labelled:
        keep = F.pmod(F.xxhash64(F.lit(seed), "url"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / labelled))
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_x")
        train = vectors.transform(ready.where(F.col("said").isNotNull() & fold(seed).between(4, 8) & keep).withColumn("_y", F.when(F.col("said") == "block", 1.0).otherwise(0.0))).select("_x", "_y")
        boosted = GBTClassifier(featuresCol="_x", labelCol="_y", predictionCol="_c", maxIter=trees, maxDepth=depth, seed=seed)
        model = boosted.setProbabilityCol("_p").setRawPredictionCol("_r").fit(scratch.put(train, "train").coalesce(2))
        score = vector_to_array("_p")[1]
        judged = model.transform(vectors.transform(ready))
        return judged.select(*out, F.coalesce("said", F.when(score > 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
    only = "block" if labelled and blocked == labelled else "allow"
    return ready.select(*out, F.coalesce("said", F.lit(only)).alias("verdict"), F.lit(float(only == "block")).alias("score"))
