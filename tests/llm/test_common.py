"""Joins with hot keys, and the bounded sample that the classifier is fitted on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.llm import quality
from emberframe.llm.common import lookup


@pytest.mark.parametrize("limit", [0, 5, 10**9])
def test_lookup_equals_a_join(spark, limit):
    rows = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40).alias("k"))
    entries = rows.groupBy("k").agg(F.count("*").alias("n")).where("k is not null and k <> 7")
    got = lookup(rows, entries, ["k"], F.col("n") > limit)
    want = rows.join(entries, "k")
    assert sorted(map(tuple, got.select("id", "k", "n").collect())) == sorted(map(tuple, want.select("id", "k", "n").collect()))


def test_long_texts_are_encoded_in_parts():
    rng = np.random.default_rng(1)
    texts = [rng.integers(32, 127, n).astype(np.uint8).tobytes() for n in (0, 5, 512, 513, 20_000, 100_001)]
    whole, per = quality.encode_passages(texts)
    for most in (1, 512, 4096, 1 << 20):
        part, n = quality.encode_texts(texts, most)
        assert (n == per).all() and np.array_equal(part, whole)


def test_fit_takes_whole_rows_up_to_its_bound(spark, monkeypatch):
    docs = [(i, ("good words " if i % 2 else "### !! ") * (400 if i in (3, 4) else 20), "x", 5) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, label string, _id int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(quality.Attention, "fit", lambda self, x, per, *rest: seen.update(rows=len(per), passages=len(x), most=int(per.max())))
    quality.learn(frame, labels, F.lit(False))
    assert seen == {"rows": 60, "passages": 58 + sum(-(-len(docs[i][1]) // 512) for i in (3, 4)), "most": -(-len(docs[3][1]) // 512)}
    quality.learn(frame, labels, F.lit(False), passages=16)  # eight of each label; the long ones do not fit
    assert seen["rows"] == 16 and seen["passages"] <= 16 and seen["most"] == 1
