"""Text operators against plain versions, with null, empty, long, tied and repeated rows."""

import base64
import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from emberframe.llm import bpe, ctw, mixing, quality, repeats, sharding, simhash, urls
from emberframe.llm.common import Scratch, connected_components
from emberframe.llm.queries_repeats import op9_repeats
from emberframe.llm.queries_urls import RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = public_tokenizers.path("byte_bpe_50k.tiktoken")


def words(rng, n):
    return " ".join(rng.choice(["the", "a", "fire", "Über", "snow-line", "Ridge,", "x1", "of"]) + rng.choice(["", "s", "ed"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base = [words(rng, rng.randrange(5, 160)) for _ in range(25)]
    shared = words(rng, 120)
    texts = [*base, base[3], base[3], base[3], None, "", "  \t", "one", "Two words", shared + " " + base[0], base[1] + shared, "ab" * 900, words(rng, 4000), "é" * 500 + "ab" * 300]
    return [(i if i != 7 else None, t, "en", None if i % 9 == 0 else f"s{i % 4 if i % 3 else 0}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows + rows[:1], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# encoding and decoding


def tiktoken_encoder():
    ranks = bpe.read_ranks(VOCAB)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(docs, empty):
    clash = docs.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2))
    enc = tiktoken_encoder()
    for r in bpe.encode_texts(clash, VOCAB, public_tokenizers.PATTERN, chunk=3000).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(r.text or "")
        assert r.decoded.decode() == (r.text or "") and r.n_tokens == len(r.ids) // 4
    assert bpe.encode_texts(empty, VOCAB, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_odd_characters():
    rng = random.Random(3)
    alphabet = "ab  \t\n\x1c\x85\xa0\u2028'st1²é漢🙂\u0301!?_"
    enc, merger = tiktoken_encoder(), bpe.Merger(bpe.read_ranks(VOCAB))
    import regex

    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40)))
        pieces = regex.findall(public_tokenizers.PATTERN, text)
        assert [int(i) for ids in merger.encode([p.encode() for p in pieces]) for i in ids] == enc.encode_ordinary(text)
    long = ("aab" * 7000 + "the" * 3000).encode()
    assert merger.encode([long])[0].tolist() == enc.encode_ordinary(long.decode())


# near duplicates by fingerprint


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(sh))


def test_xxh64_of_slices():
    rng = random.Random(5)
    data = rng.randbytes(500)
    cut = sorted((a, a + n) for n in range(0, 120) for a in [rng.randrange(0, 380)])
    got = simhash.xxh64_slices(data, np.array([a for a, _ in cut]), np.array([b for _, b in cut]), 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in cut]


def plain_components(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    low = collections.defaultdict(list)
    for i in range(len(fps)):
        low[find(i)].append(ids[i])
    return [min((x for x in low[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_simhash_components(spark, docs, empty):
    got = simhash.near_duplicates(docs, Scratch(spark)).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.fp & (2**64 - 1) == plain_fingerprint(text[r.doc_id]) for r in got)
    want = plain_components([r.fp & (2**64 - 1) for r in got], [r.doc_id for r in got])
    assert [r.component_id for r in got] == want
    assert simhash.near_duplicates(empty, Scratch(spark)).count() == 0
    kept = simhash.keep_one(docs, Scratch(spark)).collect()
    assert len(kept) == len({r.component for r in got})
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(w) for _, w in {(r.component, w) for r, w in zip(got, want)})
    nameless = spark.createDataFrame([(None, "a b c d"), (None, "quite another text here"), (None, "a b c d")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.keep_one(nameless, Scratch(spark)).collect()) == ["a b c d", "quite another text here"]


@pytest.mark.parametrize("longest", [512, 1])
def test_near_pairs_lose_no_connection(spark, longest):
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(60):
        f = rng.choice(sorted(fps))
        for _ in range(rng.randrange(1, 4)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(40)} | {0, 1 << 63, (1 << 64) - 1}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    scratch = Scratch(spark)
    edges = simhash.near_pairs(table, scratch, longest)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in edges.collect())
    got = {r.node: r.component for r in connected_components(edges, scratch).collect()}
    ids = plain_components([f & (2**64 - 1) for f in signed], signed)
    assert {f: got.get(f, f) for f in signed} == dict(zip(signed, ids))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5000, 5000)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, Scratch(spark)).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000 and 5000 not in got


def test_components_of_stars_take_no_round(spark, monkeypatch):
    written, put = [], Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, df, name: written.append(name) or put(self, df, name))
    scratch = Scratch(spark)
    stars = spark.createDataFrame([(0, 5), (9, 0), (20, 3), (3, 21), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(stars, scratch, "stars").collect()}
    assert got == {0: 0, 5: 0, 9: 0, 3: 3, 20: 3, 21: 3} and written == ["stars-0"]
    for k, edges in enumerate(([(1, 2), (2, 3)], [(1, 3), (2, 3)], [(5, 1), (6, 1), (6, 2)])):
        frame, low = spark.createDataFrame(edges, "a long, b long"), min(map(min, edges))
        assert {tuple(r) for r in connected_components(frame, scratch, f"no-star-{k}").collect()} == {(n, low) for e in edges for n in e}
    assert connected_components(stars.limit(0), scratch, "none").count() == 0 and "none-1" not in written


# repeated passages


def plain_strip(texts, n, min_words):
    seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        a = 0
        while a < len(t):
            b = a
            while b < len(t) and gone[b] == gone[a]:
                b += 1
            full = [m for m in re.finditer(rb"\S+", t) if a <= m.start() and m.end() <= b]
            if gone[a] and len(full) < min_words:
                gone[a:b] = [False] * (b - a)
            a = b
        out.append((bytes(b for b, g in zip(t, gone) if not g), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))))
    return out


def check_repeats(spark, texts, length=400, min_words=0):
    table = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {(r.th, r.n): r for r in repeats.repeated(table, Scratch(spark), length, min_words).collect()}
    keyed = table.withColumns(repeats.text_key()).collect()
    want = dict(zip(texts, plain_strip([(t or "").encode() for t in texts], length, min_words)))
    for r in keyed:
        kept, gone, runs = want[r.text]
        found = got.get((r.th, r.n))
        assert (found is not None) == bool(gone)
        if found:
            assert (bytes(found.kept), found.n_removed, found.n_spans) == (kept, gone, runs)


@pytest.mark.parametrize("length, min_words", [(400, 0), (101, 51), (101, 0), (30, 4)])
def test_repeats_equal_brute_force(spark, rows, length, min_words):
    check_repeats(spark, [r[1] for r in rows], length, min_words)


@pytest.mark.parametrize("length, crowd", [(400, 4096), (400, 20), (101, 4096), (101, 20)])
def test_repeats_in_a_hot_group(spark, monkeypatch, length, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(4)
    base = words(rng, 160)
    near = []
    for _ in range(150):  # many near copies share cores, so groups are split
        at = rng.randrange(len(base))
        near.append(base[:at] + rng.choice("QZ") + base[at + 1 :])
    check_repeats(spark, [*near, base, base, "x" * 2000, "xy" * 450, words(rng, 300)], length)


def test_repeats_in_segments_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    rng = random.Random(12)
    shared = words(rng, 150)
    check_repeats(spark, [words(rng, 900) + shared + words(rng, 400), words(rng, 200) + shared, shared + " " + shared, "ab" * 1500])


def test_repeats_of_nothing(spark, empty):
    assert repeats.repeated(empty, Scratch(spark)).count() == 0
    assert repeats.strip_repeats(empty, Scratch(spark)).columns == empty.columns


def test_strip_repeats_keeps_rows_and_columns(spark, docs):
    out = repeats.strip_repeats(docs.withColumn("kept", F.lit(1)), Scratch(spark))
    assert out.columns == [*docs.columns, "kept"] and out.count() == docs.count()
    assert out.where("text is null").count() == docs.where("text is null").count()


def test_op9_goes_by_400_bytes_not_by_words(spark, tmp_path):
    rng = random.Random(21)
    short, enough, copy = (" ".join(f"w{rng.randrange(10**4):04}" for _ in range(90))[:n] for n in (399, 400, 500))
    assert len(short.split()) > 50
    texts = [f"a{short}b", f"c{short}d", f"e{enough}f", f"g{enough}h", copy, copy, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in op9_repeats(spark, str(tmp_path)).collect())
    left = [f"a{short}b", f"c{short}d", "ef", "gh", "", "", "", ""]
    gone = [(401, 0, 0), (401, 0, 0), (402, 400, 1), (402, 400, 1), (500, 500, 1), (500, 500, 1), (0, 0, 0), (0, 0, 0)]
    assert got == [(i, *g, hashlib.sha256(t.encode()).hexdigest(), t) for i, (g, t) in enumerate(zip(gone, left))]


# mixing


def plain_mix(rows, seed=7):
    size = [len([w for w in (t or "").encode().split()]) for _, t, *_ in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    capped = {s for s in sources if total[s] == 0}
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        level = left / max(1, sum(weight[s] for s in sources if s not in capped))
        more = {s for s in sources if s not in capped and weight[s] * level > 3 * total[s]}
        if not more:
            return size, total, {s: 3.0 * total[s] if s in capped else weight[s] * level for s in sources}
        capped |= more


def test_mixing_targets_and_copies(spark, docs, rows, empty):
    every = rows + rows[:1]
    size, total, target = plain_mix(every)
    mixed = mixing.mix(docs.withColumn("size", F.lit("clash")), Scratch(spark)).collect()
    assert len(mixed) == len(every)
    taken, largest = collections.Counter(), collections.Counter()
    for r in mixed:
        assert math.isclose(r.target, target[r.source]) and r.source_size == total[r.source] and 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)
    again = mixing.mix(docs.repartition(5), Scratch(spark)).collect()
    key = lambda r: (str(r.doc_id), str(r.text), r.copies)
    assert sorted(map(key, mixed)) == sorted(map(key, again))
    assert mixing.repeat_rows(mixing.mix(docs, Scratch(spark))).count() == sum(r.copies for r in mixed)
    assert mixing.mix(empty, Scratch(spark)).count() == 0
    nameless = [(None, f"word {i % 2} more", "en", f"s{i % 3}", 1) for i in range(300)] + [(1, "same row here", "en", "s9", 1)] * 200
    every = [(*r, 1, 2) for r in nameless]
    table = spark.createDataFrame(every, SCHEMA + ", cut int, tied int").repartition(4)
    size, total, target = plain_mix(nameless)
    got, taken = mixing.mix(table, Scratch(spark)).collect(), collections.Counter()
    for r in got:
        taken[r.source] += r.size * r.copies
    assert all(abs(taken[s] - target[s]) <= 3 for s in target) and {(r.cut, r.tied) for r in got} == {(1, 2)}


# sharding


def test_sharding_balances_bytes(spark, docs, empty):
    rng = random.Random(2)
    hot = [(i, "same text", "en", "s", 9) for i in range(400)] + [(1000 + i, words(rng, rng.randrange(1, 30)), "en", "s", 1) for i in range(900)] + [(None, None, "en", "s", 0)] * 3
    table = spark.createDataFrame(hot, SCHEMA).repartition(4)
    got = sharding.shard_by_bytes(table.withColumn("slot", F.lit("clash")), Scratch(spark)).collect()
    assert len(got) == len(hot)
    per, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        assert r.size == len((r.text or "").encode()) + 8
        per[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(per) == set(range(24)) and max(per.values()) - min(per.values()) <= 2 * max(r.size for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    split = collections.defaultdict(set)
    for r in got:
        split[r.text].add(r.shard)
    assert sum(len(s) > 1 for t, s in split.items() if t != "same text") == 0
    copies = [(i, f"text {i % 70} " + "x" * (40 * (i % 70)), "en", "s", 9) for i in range(2100)]  # groups of up to most of a shard
    copies += [(9000 + i, f"other {i} " + "y" * 280, "en", "s", 9) for i in range(3000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(copies, SCHEMA).repartition(4).withColumn("h", F.lit(5)).withColumn("part", F.lit(6)), Scratch(spark)).collect()
    per, split = collections.Counter(), collections.defaultdict(set)
    for r in got:
        per[r.shard] += r.size
        split[r.text].add(r.shard)
    assert all(len(s) == 1 for s in split.values()) and {(r.h, r.part) for r in got} == {(5, 6)}
    assert max(per.values()) <= 1.02 * min(per.values())
    assert all(sorted(r.slot for r in got if r.shard == n) == list(range(sum(r.shard == n for r in got))) for n in per)
    assert sharding.shard_by_bytes(empty, Scratch(spark)).count() == 0


def test_sharding_takes_text_ids(spark):
    rows = [(f"id-{i}" if i else None, f"text {i % 70} " * (i % 9)) for i in range(400)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id string, text string").repartition(3), Scratch(spark), shards=4).collect()
    assert sorted((r.doc_id or "", r.text) for r in got) == sorted((i or "", t) for i, t in rows)
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(4)]
    assert max(sizes) - min(sizes) < 400


def test_counts_below_probes(spark, docs):
    keyed = docs.select(F.xxhash64("text").alias("h"), F.coalesce("doc_id", F.lit(0)).alias("k"), F.lit(5).cast("long").alias("size"))
    rows = [((r.h + (1 << 63)) << 64 | (r.k + (1 << 63)), r.size) for r in keyed.collect()]
    probes = sorted({0, rows[0][0], rows[1][0] + 1, rows[5][0], (1 << 128) - 1})
    assert sharding.below(keyed, probes) == [(sum(s for k, s in rows if k < p), sum(k < p for k, _ in rows)) for p in probes]


# urls


def plain_rule(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None
    rest = url[at + 3 :]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fit = [(len(r), r) for _, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fit)[1] if fit else None


def test_url_rules_and_trees(spark):
    rng = random.Random(6)
    made = [f"https://{rng.choice(['', 'www.', 'm.'])}{rng.choice(['ab', 'casino-win', 'x'])}.example.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randrange(3000)}{rng.choice(['', '?a=1&b=2', '#top'])}" for _ in range(200)]
    odd = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG", "http://É.ORG/x", "a://b://c/d", "http://example.org/en/1", "http://notexample.org/es/", "http://example.org/es/é?x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(made + odd * 2)], "page_id long, url string")
    clash = pages.withColumns({"host": F.lit(1), "depth": F.lit("own"), "suffix": F.lit("mine"), "_n": F.lit(3)})
    got = urls.judge(clash, Scratch(spark), RULES, trees=3).collect()
    assert {(r.depth, r.suffix, r._n) for r in got} == {("own", "mine", 3)}
    verdict = {r: v for v, r in RULES}
    assert len(got) == pages.count()
    for r in got:
        assert (r.host, r.path, r.rule) == plain_rule(r.url)
        assert r.verdict == verdict[r.rule] if r.rule else r.verdict in ("allow", "block")
    none = urls.judge(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), Scratch(spark), RULES).collect()
    assert [(r.verdict, r.rule) for r in none] == [("allow", None)]
    assert urls.judge(pages.limit(0), Scratch(spark), RULES).count() == 0


def test_trees_predict_held_out_labels(spark):
    rng = random.Random(7)
    bad, good = ["casino-win", "free-pills", "x-bet-24"], ["news", "library", "docs", "shop"]
    made = []
    for i in range(3000):
        block = rng.random() < 0.4
        host = f"{rng.choice(bad if block else good)}{rng.randrange(90)}.{rng.choice(['net', 'info'])}"
        tail = f"?id={rng.randrange(10**9)}&ref={rng.randrange(99)}" if block else f"{rng.choice(['guide', 'about', 'page'])}/"
        made.append((i, f"http://{host}/{'b' if block else 'a'}{i % 2}/{tail}", block))
    rules = [("block", "net/b0"), ("allow", "net/a0"), ("block", "info/b0"), ("allow", "info/a0")]
    truth = {i: block for i, _, block in made}
    got = urls.judge(spark.createDataFrame([m[:2] for m in made], "page_id long, url string"), Scratch(spark), rules).collect()
    unruled = [r for r in got if r.rule is None]
    assert len(unruled) > 1000 and sum((r.verdict == "block") == truth[r.page_id] for r in unruled) / len(unruled) > 0.95


def test_no_feature_knows_a_row_s_own_label(spark):
    """Labels drawn by a coin, from which nothing can be learnt: held-out urls are not foretold."""
    rng = random.Random(9)
    made, rules = [], []
    for host in range(60):  # a coin for each url of a suffix: only its own label, left out of the share, would tell
        for k in range(40):
            made.append(f"http://h{host}.net/{rng.choice('ab')}/{rng.randrange(10**6)}")
    rules = [("block", "net/a"), ("allow", "net/b")]
    swap = str.maketrans("ab", "qq")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(made)], "page_id long, url string")
    blank = pages.withColumn("url", F.translate("url", "ab", "qq"))  # what the trees may see is the same for both
    assert len({u.translate(swap).count("q") for u in made}) == 1
    from unittest import mock

    real = urls.lexical
    with mock.patch.object(urls, "lexical", lambda p: real(p.withColumn("url", F.regexp_replace("url", "/[ab]/", "/q/")).withColumn("path", F.regexp_replace("path", "/[ab]/", "/q/")))):
        got = urls.judge(pages, Scratch(spark), rules).withColumn("fold", urls.fold(5)).collect()
    assert blank.count() == len(got)
    for folds in ((4, 5, 6, 7, 8), (9,)):
        mine = [r for r in got if r.fold in folds]
        right = sum((r.score > 0.5) == (r.rule == "net/a") for r in mine) / len(mine)
        assert right < 0.75 if len(folds) > 1 else 0.35 < right < 0.65  # trees fit chance a little, held-out rows not at all


def test_urls_of_the_pages_table(spark):
    path = os.environ.get("TEST_URL_DIR", "/root/testdata/sf0.01")
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    pages = spark.read.parquet(f"{path}/pages.parquet").select("page_id", "url")
    got = urls.judge(pages, Scratch(spark), RULES).withColumn("fold", urls.fold(5)).collect()
    verdict = {r: v for v, r in RULES}
    held = [r for r in got if r.rule and r.fold == 9]
    right = sum(("block" if r.score > 0.5 else "allow") == verdict[r.rule] for r in held) / len(held)
    unruled = [r for r in got if not r.rule]
    print(len(held), right, len(unruled), sum(r.verdict == "block" for r in unruled), len({round(r.score, 4) for r in unruled}))
    assert right > 0.7 and len({round(r.score, 6) for r in unruled}) > 10
    assert 0 < sum(r.verdict == "block" for r in unruled) < len(unruled)


# language model


def plain_tree(texts, depth):
    """Nodes by context: next-byte counts."""
    nodes = collections.defaultdict(collections.Counter)
    for t in texts:
        data = b"\n" * depth + ctw.normal(t)
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                nodes[data[i - d : i]][data[i]] += 1
    return nodes


def plain_probability(nodes, depth, context, byte):
    """Probability of a byte by recursion over every node of the full tree."""
    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(n[0] + n[1] + 1) - math.log(math.pi)

    def split(ctx, bit, prefix):
        n = [0, 0]
        for b, c in nodes.get(ctx, {}).items():
            if b >> (8 - bit) == prefix:
                n[b >> (7 - bit) & 1] += c
        return n

    def weighted(ctx, bit, prefix):
        n = split(ctx, bit, prefix)
        if len(ctx) == depth:
            return kt(n)
        kids = [c for c in list(nodes) if len(c) == len(ctx) + 1 and c.endswith(ctx)]
        return math.log(0.5) + np.logaddexp(kt(n), sum(weighted(k, bit, prefix) for k in kids))

    p = 1.0
    for bit in range(8):
        prefix, want = byte >> (8 - bit), byte >> (7 - bit) & 1
        q = None
        for d in range(depth, -1, -1):
            ctx = context[len(context) - d :]
            n = split(ctx, bit, prefix)
            own = (n[want] + 0.5) / (sum(n) + 1)
            if d == depth or q is None:
                q = own if sum(n) else None
                continue
            stay = math.exp(math.log(0.5) + kt(n) - weighted(ctx, bit, prefix))
            q = stay * own + (1 - stay) * q
        p *= 0.5 if q is None else q
    return p


@pytest.mark.parametrize("depth", [1, 2, 4, 5])
def test_context_tree_equals_plain_recursion(spark, depth):
    train = ["aab ab", "abba", "b", "abbab aab"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*train, "abab", "zz", "abc", None, ""])], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in ctw.score(docs, F.col("doc_id") < 4, Scratch(spark), depth=depth, block=10).collect()}
    nodes = plain_tree(train, depth)
    for r in docs.collect():
        data = b"\n" * depth + ctw.normal(r.text)
        want = sum(math.log10(plain_probability(nodes, depth, data[i - depth : i], data[i])) for i in range(depth, len(data)))
        assert math.isclose(got[r.doc_id].score, want, rel_tol=1e-5)


def test_tree_probabilities_sum_to_one(spark):
    rng = random.Random(3)
    texts = [words(rng, 60) for _ in range(5)]
    probes = [texts[0][:40] + chr(c) for c in range(33, 127)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + probes + [texts[0][:40]])], "doc_id long, text string")
    got = {r.doc_id: 10 ** r.score for r in ctw.score(docs, F.col("doc_id") < 5, Scratch(spark)).collect()}
    assert sum(v for i, v in got.items() if 5 <= i < 99) <= sum(v for i, v in got.items()) and all(0 < v <= 1 for v in got.values())


def test_word_base(spark, docs, rows, empty):
    train = F.expr("doc_id % 3 <> 0")
    clash = docs.withColumn("score", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("block", F.lit(2)).withColumn("kind", F.lit(3))
    got = ctw.score(clash, train, Scratch(spark)).collect()
    counts = collections.Counter()
    n = 0
    for r in docs.where(train).collect():
        counts.update((r.text or "").encode().lower().split())
        n += 1
    total, kinds = sum(counts.values()) + n, len(counts) + 1
    by_id = {r.doc_id: (r.text or "") for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        w = by_id[r.doc_id].encode().lower().split()
        base = sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w) + math.log10((n + 1) / (total + kinds + 1))
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.n_tokens == len(w) + 1
        assert r.n_known == sum(counts[x] > 0 for x in w) + 1 and r.train_tokens == total
        assert (r.row, r.block, r.kind) == (1, 2, 3)
    none = ctw.score(docs, F.lit(False), Scratch(spark)).collect()
    assert all(math.isclose(r.bits_per_byte, 8, rel_tol=1e-6) and r.base_score == 0 and r.n_known == 0 for r in none)
    assert ctw.score(empty, F.lit(True), Scratch(spark)).count() == 0


# quality


def test_quality_learns_and_keeps_its_contract(spark, empty):
    rng = random.Random(9)
    data = []
    for i in range(400):
        t = words(rng, rng.randrange(3, 200))
        data.append((i, t if i % 4 else " ".join(w + "###" for w in t.split()), "en", "s", 0))
    docs = spark.createDataFrame(data + [(400, None, "en", "s", 0), (401, "", "en", "s", 0), (402, words(rng, 30000), "en", "s", 0)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(5, 1), (6, 0), (6, 1)], "doc_id long, quality int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality.learn(docs, labels, held)
    got = quality.score(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    out = [r for r in got if r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in out) / len(out) > 0.95
    assert quality.learn(docs, labels.where("quality = 1"), held) == 1.0 and quality.learn(docs, labels.limit(0), held) == 0.5
    assert quality.learn(empty, labels, held) == 0.5
    assert quality.score(docs, 0.5).where("predicted = 1").count() == 403
    assert quality.score(empty, model).count() == 0


def test_forward_equals_plain_attention():
    texts = [b"some words " * 90, b"", b"\x00\xff" * 400 + b"tail"]
    x, per = quality.encode_passages(texts)
    m = quality.Attention.new(x, 4, 3, 2)
    got, at = m.forward(x, per)[0], 0
    for n, p in zip(per, got):
        hidden, logits = [], []
        for row in x[at : at + n]:
            z = [min(8, max(-8, (v - a) / b)) for v, a, b in zip(row, m.mean, m.scale)]
            h = [math.tanh(sum(z[i] * m.w["E"][i][j] for i in range(len(z))) + m.w["e"][j]) for j in range(4)]
            v = [math.tanh(sum(h[i] * m.w["V"][i][j] for i in range(4))) for j in range(3)]
            u = [1 / (1 + math.exp(-sum(h[i] * m.w["U"][i][j] for i in range(4)))) for j in range(3)]
            hidden.append(h)
            logits.append(sum(a * b * c for a, b, c in zip(v, u, m.w["a"])))
        weight = [math.exp(v) for v in logits]
        bag = [sum(w * h[j] for w, h in zip(weight, hidden)) / sum(weight) for j in range(4)]
        assert math.isclose(p, 1 / (1 + math.exp(-sum(a * b for a, b in zip(bag, m.w["c"])) - m.w["b"][0])), rel_tol=1e-4)
        at += n


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, per, y = rng.normal(size=(9, 5)).astype(np.float64), np.array([2, 3, 1, 3]), np.array([0.0, 1.0, 1.0, 0.0])
    m = quality.Attention.new(x, 4, 3, 0)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    sample = np.array([1.0, 0.5, 2.0, 1.0])

    def loss():
        p = m.forward(x, per)[0]
        return -(sample * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    for k, g in m.gradients(x, per, y, sample).items():
        flat = m.w[k].reshape(-1)
        for i in range(0, flat.size, 3):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert math.isclose((up - down) / 2e-6, np.asarray(g).reshape(-1)[i], abs_tol=1e-6)


def test_token_digests_are_of_little_endian_ids(docs):
    r = bpe.encode_texts(docs.where("text = 'one'"), VOCAB, public_tokenizers.PATTERN).withColumn("h", F.sha2("ids", 256)).first()
    ids = tiktoken_encoder().encode_ordinary("one")
    assert r.h == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert base64.b64decode("b25l") == bytes(r.decoded)
