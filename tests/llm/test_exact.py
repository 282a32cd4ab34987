"""Exact duplicates: labels against a plain count, batches in any order, edge rows."""

import hashlib
import random
import uuid

import pytest

from emberframe.llm.common import Scratch
from emberframe.llm.exact import DigestIndex, digests, drop_duplicates, label

SCHEMA = "doc_id long, text string, digest string, row int, turn string"


def index(spark, scratch, buckets=4, kind="bigint"):
    return DigestIndex(spark, f"{scratch.root}/index-{uuid.uuid4().hex}", f"t_{uuid.uuid4().hex}", buckets, kind)


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in pairs], SCHEMA)


def expected(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs), key=str), keep


@pytest.mark.parametrize("seed", [1, 2])
def test_labels(spark, seed):
    rng = random.Random(seed)
    texts = ["", None, "a", "A", "a ", "é", "é", "long " * 20_000] + [str(k) for k in range(30)]
    pairs = [(i, "hot" if rng.random() < 0.4 else rng.choice(texts)) for i in range(400)]
    pairs += [pairs[5], pairs[5], (None, "hot"), (None, "only null"), (None, "only null")]
    scratch = Scratch(spark)
    rows = scratch.put(digests(frame(spark, pairs)), "digests")
    at = index(spark, scratch)
    for part in ("uid % 3 = 1", "uid % 3 = 0", "uid % 3 = 0", "uid % 3 = 2"):  # one batch comes twice
        at.add(rows.where(part))
    got = label(rows, at, scratch).collect()
    want, keep = expected(pairs)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len({bytes(r.digest) for r in got}) and all(r.doc_id == r.keep_id for r in kept)
    assert at.entries().count() == len(keep) and at.missing(rows).isEmpty()
    small = at.compact(f"{scratch.root}/small", f"t_{uuid.uuid4().hex}")
    assert small.rows().count() == len(keep) and small.missing(rows).isEmpty()


def test_index_outlives_its_name(spark):
    scratch = Scratch(spark)
    rows = scratch.put(digests(frame(spark, [(1, "a"), (2, "b")])), "digests")
    at = index(spark, scratch)
    at.add(rows)
    at.forget()
    again = DigestIndex(spark, at.path, "reopened", at.buckets)
    assert sorted(r.keep_id for r in again.entries().collect()) == [1, 2] and again.missing(rows).isEmpty()
    again.forget()


def test_index_is_not_shuffled(spark):
    scratch = Scratch(spark)
    rows = scratch.put(digests(frame(spark, [(1, "a")])), "digests")
    at = index(spark, scratch)
    at.add(rows)
    plan = at.missing(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "Exchange" not in at.entries()._jdf.queryExecution().executedPlan().toString()


def test_drop_duplicates_keeps_columns_and_earlier_texts(spark):
    scratch = Scratch(spark)
    at = index(spark, scratch)
    first = drop_duplicates(frame(spark, [(1, "a"), (3, "a"), (3, "a"), (2, None), (4, "")]), at, Scratch(spark)).collect()
    assert sorted((r.doc_id, r.text, r.digest, r.row, r.turn) for r in first) == [(3, "a", "x", 1, "y"), (4, "", "x", 1, "y")]
    later = drop_duplicates(frame(spark, [(2, "a"), (9, "new")]), at, Scratch(spark)).collect()
    assert [r.doc_id for r in later] == [9]


def test_empty_and_text_ids(spark):
    scratch = Scratch(spark)
    at = index(spark, scratch, kind="string")
    none = spark.createDataFrame([], "doc_id string, text string")
    assert drop_duplicates(none, at, scratch).isEmpty()
    got = drop_duplicates(spark.createDataFrame([("b", "x"), ("a", "x")], "doc_id string, text string"), at, Scratch(spark)).collect()
    assert [r.doc_id for r in got] == ["b"]
