"""The pipeline on the smallest tables: columns, decisions and exact round trip."""

import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(p.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(p.STAGES) - 1:
            assert docs.columns == columns
        if name in ("quality_classifier", "simhash_near_dedup"):
            rows = docs.collect()
            assert len(rows) == len({r.doc_id for r in rows}) and all(seen[r.doc_id] == r.text for r in rows)
        if name == "suffix_array_dedup":
            seen = {r.doc_id: r.text for r in docs.collect()}
    rows = docs.collect()
    assert rows and all(r.text == seen[r.doc_id] and r.n_tokens == len(r.ids) // 4 for r in rows)
    assert len(p.STAGES) == 5


def test_stages_take_clashing_columns_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as p
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = {c: F.lit("mine") for c in ("label", "_id", "_key", "_body", "_one", "key", "body", "turn", "row", "fp", "component", "score", "predicted", "n", "th", "kept", "copies", "size", "ids")}
    wide = docs.withColumns(extra).withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    for name, stage in p.STAGES:
        got = stage(spark, wide, DATA)
        assert "label" not in got.columns and got.count() > 0, name
        assert stage(spark, wide.limit(0), DATA).count() == 0, name


def test_keep_first_passes_all_columns(spark):
    from pyspark.sql import functions as F

    from emberframe.llm import simhash
    from emberframe.llm.common import Scratch

    rows = [(1, "same words here", "k1"), (1, "same words here", "k2"), (2, "same words here", "k3"), (None, None, "k4"), (7, "", "k5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string").withColumns({"_body": F.lit(3), "key": F.lit("x"), "turn": F.create_map(F.lit("a"), F.lit(1))})
    got = simhash.keep_one(docs, Scratch(spark))
    assert got.columns == docs.columns
    kept = sorted((r.doc_id, r._key) for r in got.collect())
    assert [k[0] for k in kept] == [1, 7] and kept[0][1] in ("k1", "k2") and kept[1][1] == "k5"


def components(texts):
    """Smallest index reachable over five-word sets of similarity 0.8 or more, comparing all pairs."""
    cut = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in cut]
    low = list(range(len(texts)))
    links = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if 5 * len(x & y) >= 4 * len(x | y)]
    while any(low[i] != low[j] for i, j in links):
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    return low


def planted(rng):
    """(doc_id, text, lang, source, n_chars), and the ids of junk: copies, near copies, a shared passage, null and empty."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    texts = [" ".join(word() for _ in range(rng.randrange(20, 160))) for _ in range(260)]
    passage, junk = " ".join(word() for _ in range(60)), set(range(0, 260, 5))
    for i in junk:
        texts[i] = " ".join(w + "###" for w in texts[i].split())
    for i in range(1, 260, 20):
        texts[i + 1] = texts[i]
        near = texts[i].split()
        near[len(near) // 2] = "changed"
        texts[i + 2] = " ".join(near)
    for i in range(8, 260, 30):
        texts[i] = texts[i] + " " + passage + " " + texts[i][:30]
    texts += [None, "", None]
    return [(i, t, "en", ("a", "b", "c", None)[i % 4], len(t or "")) for i, t in enumerate(texts)], junk


def targets(size):
    """Words wanted of each source: shares 5, 2, 1 in order, three times the source at most, the rest dealt again."""
    order = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, left, free = {}, float(sum(size.values())), set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * size[s]}
        if not over:
            return {**full, **{s: left * weight[s] / total for s in free}}
        full |= {s: 3.0 * size[s] for s in over}
        left, free = left - sum(3.0 * size[s] for s in over), free - over
    return full


def test_run_equals_a_brute_force_pipeline(spark, tmp_path, monkeypatch):
    import collections
    import random

    import corpus_pipeline as p
    from test_text_operators import plain_strip, tiktoken_encoder

    rows, junk = planted(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i not in junk)) for i in range(260)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))

    first = str(tmp_path / "first")
    p.quality_classifier(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).write.parquet(first)
    good = sorted(spark.read.parquet(first).collect())
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r.doc_id] == r.text for r in good)
    wrong = {r.doc_id for r in good if r.doc_id < 260} ^ (set(range(260)) - junk)
    assert len(wrong) <= 8
    monkeypatch.setattr(p, "STAGES", [("quality_classifier", lambda spark, docs, sf_dir: spark.read.parquet(first)), *p.STAGES[1:]])

    low = components([r.text for r in good])
    single = [r for i, r in enumerate(good) if low[i] == i]
    assert len(single) <= len(good) - 15
    kept = plain_strip([(r.text or "").encode() for r in single], 101, 51)
    left = {r.doc_id: None if r.text is None else k[0].decode() for r, k in zip(single, kept)}
    assert sum(k[1] > 0 for k in kept) >= 5

    got = p.run(spark, str(tmp_path)).collect()
    encoder = tiktoken_encoder()
    for r in got:
        text = left[r.doc_id] or ""
        assert (r.text or "") == text and (r.n_chars or 0) == len(text)
        ids = encoder.encode_ordinary(text)
        assert r.n_tokens == len(ids) and bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)
    copies = collections.Counter(r.doc_id for r in got)
    source = {r.doc_id: r.source for r in single}
    words = {i: len((t or "").split()) for i, t in left.items()}
    size = collections.Counter()
    for i, s in source.items():
        size[s] += words[i]
    for s, want in targets(size).items():
        mine = [i for i in source if source[i] == s and words[i]]
        assert abs(sum(copies[i] * words[i] for i in mine) - want) <= max(words[i] for i in mine)
        assert max(copies[i] for i in mine) - min(copies[i] for i in mine) <= 1 and max(copies[i] for i in mine) <= 3


@pytest.mark.parametrize("longest", [128, 8, 2])
def test_near_copies_equal_brute_force(spark, longest):
    import random

    import corpus_pipeline as p
    from emberframe.llm import jaccard
    from emberframe.llm.common import Scratch

    rng, texts = random.Random(5), [None, "", " ", "one two", "One  two", "a b c d"]
    for size in (30, 120, 300):
        for _ in range(4):
            base = [f"w{rng.randrange(5000)}" for _ in range(size)]
            texts.append(" ".join(base))
            for edits in (1, 1, 2, size // 60, size // 40, size // 30, size // 20):
                new = list(base)
                for at in rng.sample(range(size), edits):
                    new[at] = f"v{rng.randrange(5000)}"
                texts.append(" ".join(new))
    low = components(texts)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = jaccard.near_duplicates(docs, Scratch(spark), longest=longest).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(low))
    kept = {r.doc_id for r in p.simhash_near_dedup(spark, docs, DATA).collect()}
    assert kept == set(low) and len(kept) < len(texts)


def test_simhash_links_come_first_and_spread_groups_stay_small(spark):
    import random

    from emberframe.llm import jaccard
    from emberframe.llm.common import Scratch

    rng, word = random.Random(9), lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(150)]

    def edited(many):
        new = list(base)
        for at in rng.sample(range(5, 145), many):
            new[at] = word()
        return " ".join(new)

    texts = [" ".join(base)] + [edited(many) for many in (1, 2, 3, 4, 4, 5) for _ in range(60)]
    pair = [f"p{i}" for i in range(400)]
    texts += [" ".join(pair), " ".join([*pair, "end"])]
    scratch, put, seen = Scratch(spark), Scratch.put, {}

    def watched(df, name):
        seen[name] = put(scratch, df, name)
        return seen[name]

    scratch.put = watched
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, scratch).collect()}
    assert got == dict(enumerate(components(texts)))
    assert seen["edges-simhash"].count() > 0 and got[len(texts) - 1] == len(texts) - 2
    linked = {x for r in seen["edges-simhash"].collect() for x in r}
    sets = {r.doc_id: r.cid for r in seen["marked"].collect()}
    assert {sets[len(texts) - 2], sets[len(texts) - 1]} <= linked
    assert sum(seen[n].count() for n in seen if n.startswith("pairs-")) < 8 * len(texts)


def test_near_duplicates_find_components_once_for_new_edges(spark, monkeypatch):
    import random

    from emberframe.llm import jaccard
    from emberframe.llm.common import Scratch

    rng, written, put = random.Random(4), [], Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, df, name: written.append(name) or put(self, df, name))
    texts, passage = [], " ".join(f"p{i}" for i in range(12))
    for k in range(24):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        texts.append(" ".join(base) + " " + passage)
        for at in rng.sample(range(10, 110), k % 4):
            texts.append(" ".join([*base[:at], "new", *base[at + 1 :]]) + " " + passage)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, Scratch(spark)).collect()}
    assert got == dict(enumerate(components(texts)))
    # one set of tables for each turn that found new edges, none for all edges once more at the end
    groups = [n for n in written if n.startswith("components-")]
    assert len(groups) <= 2 and len([n for n in written if n.startswith("cc-")]) <= 2 * len(groups)
    assert "cc-0" not in written and len(written) <= 30
