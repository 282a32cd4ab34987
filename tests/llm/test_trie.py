"""Conversation trie: every node against the definition; contraction of deep chains; edge rows."""

import hashlib
import math
import random
import re
import zlib

import pytest

from emberframe.llm import trie
from emberframe.llm.common import Scratch
from emberframe.llm.trie import list_digests, prefix_trie, subtree_sums

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def brute(rows):
    """Rows of one turn must be equal here, as their order is by hash. Remainders are truncated, as SQL's are."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out, totals = [], {}
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    for path in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in kids.get(path, [])]
        saved = (len(members[path]) - 1) * (len(WORDS.findall(path[-1][1])) if path else 0)
        totals[path] = (sum(b[0] for b in below) if below else 1, saved + sum(b[1] for b in below))
        ends = sorted(c for c in members[path] if len(made[c]) == len(path))
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(kids.get(path, [])),
                    *totals[path], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_definition(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 4)
    monkeypatch.setattr(trie, "CHUNK", 8)
    rng, rows = random.Random(seed), []
    for c in [*range(0, 90), *range(203, 240), -7, 10**12]:
        if rng.random() < 0.15:
            continue
        same = rng.random() < 0.4  # copies of one conversation
        for k in range(6 if same else rng.choice([1, 2, 3, 7, 12])):
            text = f"turn {k} of all" if same or (k < 3 and rng.random() < 0.7) else rng.choice(["", None, "a b", f"own {c} {k}", "é ü\tz"])
            rows.append((c, None if k == 0 and not same else k, rng.choice(["user", "user", None]) if not same else "user", text))
    rows += [(41, k, "user", f"deep {k % 5}") for k in range(1000, 1150)]  # a chain much deeper than the rest
    rows += [(None, 1, "user", "nobody"), (42, 5000, "user", "twice"), (42, 5000, "user", "twice")]
    assert rows_of(prefix_trie(frame(spark, rows), Scratch(spark))) == brute(rows)


def test_turnless_and_empty(spark):
    rows = [(21, 1, "user", "a")]  # its opening comes from conversation 20, which is absent
    c = next(c for c in range(21, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(c, 1, "user", "a")]
    assert rows_of(prefix_trie(frame(spark, rows), Scratch(spark))) == brute(rows)
    assert rows_of(prefix_trie(frame(spark, rows), Scratch(spark)))[0][:2] == (c, 0)
    assert prefix_trie(frame(spark, []), Scratch(spark)).isEmpty()


def test_contraction_of_a_long_chain_takes_few_rounds(spark):
    """A comb: a chain of 600 nodes with a leaf at every 50th."""
    n, put = 600, []

    class Counted(Scratch):
        def put(self, df, name):
            put.append(name)
            return super().put(df, name)

    nodes = [(0, d, 0 if d else None, (1 if d < n - 1 else 0) + (d % 50 == 0 and d < n - 1), 1, d) for d in range(n)]
    nodes += [(d, d + 1, 0, 0, 1, 1000) for d in range(50, n - 1, 50)] + [(7, 1, 0, 0, 1, 1000)]
    tree = spark.createDataFrame(nodes, "conv_id long, depth long, parent_conv_id long, n_children long, a long, b long")
    got = {(r.conv_id, r.depth): (r.a, r.b) for r in subtree_sums(tree, ["a", "b"], Counted(spark)).collect()}
    assert len(got) == len(nodes) and sum(name.startswith("inner") for name in put) <= 18
    for d in range(n):
        teeth = sum(1 for t in [0, *range(50, n - 1, 50)] if t >= d)
        assert got[0, d] == (n - d + teeth, sum(range(d, n)) + 1000 * teeth)


def test_list_digests_are_streamed(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 10)
    ids = spark.range(0, 5000).selectExpr("id * 3 AS v", "CASE WHEN id < 4000 THEN 1 ELSE id END AS k")
    got = {r.k: r.ends_sha256 for r in list_digests(ids, ["k"], "v").collect()}
    assert got[1] == hashlib.sha256(",".join(str(3 * i) for i in range(4000)).encode()).hexdigest()
    assert len(got) == 1001 and got[4500] == hashlib.sha256(b"13500").hexdigest()
