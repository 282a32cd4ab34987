"""Near-duplicate texts: SimHash links that the Jaccard similarity confirms, completed by prefix lists of rare shingles."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import Scratch, by_value, connected_components
from emberframe.llm.simhash import _body, majority, near_pairs, xxh64_slices

by_value(__name__)

BUCKETS = 1 << 20  # of shingle counts, a fixed size: they only order shingles, rare ones first
PARITY_BITS = 512  # of a set's fingerprint: a bit tells whether a bucket holds an odd number of its shingles


def shingle_sets(texts, words: int, seed: int, chunk: int = 1 << 21):
    """Sorted distinct hashes of each text's shingles; a text of fewer words is one shingle.

    Texts are hashed together, about ``chunk`` bytes at a time.
    """
    parts, starts, ends, sizes, base = [], [], [], [], 0

    def hashed():
        h = xxh64_slices(b"".join(parts), np.concatenate(starts), np.concatenate(ends), seed)
        return map(np.unique, np.split(h, np.cumsum(sizes)[:-1]))

    for text in texts:
        tokens = (text.as_py() or "").encode().lower().split()
        lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        end, k = np.cumsum(lens + 1) - 1, min(words, len(tokens))
        many = len(tokens) - k + 1 if tokens else 0
        parts.append(b" ".join(tokens))
        starts.append((end - lens)[:many] + base)
        ends.append(end[k - 1 :] + base if tokens else end)
        sizes.append(many)
        base += len(parts[-1])
        if base >= chunk:
            yield from hashed()
            parts, starts, ends, sizes, base = [], [], [], [], 0
    if parts:
        yield from hashed()


def _parity(shingles: np.ndarray) -> np.ndarray:
    """Parity fingerprint of a set, as longs: those of two sets differ in no more bits than the sets in shingles."""
    odd = np.bincount((shingles >> np.uint64(20) & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _cid(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _shingle_counts(docs: DataFrame, words: int, seed: int, blocks: int = 64) -> np.ndarray:
    """In how many rows of ``docs`` (text) the shingles of each hash bucket occur."""

    def run(batches):
        held = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            for s in shingle_sets(batch.column(0), words, seed):
                at = (s % np.uint64(BUCKETS)).astype(np.int64)
                np.add.at(held, at, 1)
        parts = held.reshape(blocks, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "counts"])

    def add(block: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in block["counts"])
        return pd.DataFrame({"block": block["block"][:1], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    shape = "block int, counts binary"
    rows = docs.select("text").mapInArrow(run, shape).groupBy("block").applyInPandas(add, shape).collect()  # ``blocks`` rows
    out = np.zeros((blocks, BUCKETS // blocks), np.int32)
    for r in rows:
        out[r.block] = np.frombuffer(r.counts, np.int32)
    return out.reshape(-1)


def _marked(docs: DataFrame, counts, words: int, seed: int) -> DataFrame:
    """(doc_id, body, cid, n, prefix, fp, sim): the set's hash, size, rarest shingles, parity fingerprint and SimHash.

    Sets of similarity 0.8 or more share a shingle, and most of what they share, among the
    n - ceil(0.8 n) + 1 that come first in any one order of all shingles.
    """

    def run(batches):
        seen = counts.value
        for batch in batches:
            cids, sizes, prefixes, prints, sims = [], [], [], [], []
            for s in shingle_sets(batch.column(1), words, seed):
                first = np.lexsort((s, seen[(s % np.uint64(BUCKETS)).astype(np.int64)]))[: len(s) - -(-4 * len(s) // 5) + 1]
                cids.append(_cid(s))
                sizes.append(len(s))
                prefixes.append(s[first].view(np.int64))
                prints.append(_parity(s))
                sims.append(majority(s, np.array([len(s)]))[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(cids, pa.int64()), pa.array(sizes, pa.int64()),
                 *(pa.array(x, pa.list_(pa.int64())) for x in (prefixes, prints)), pa.array(np.array(sims, np.uint64).view(np.int64))],
                names=["doc_id", "body", "cid", "n", "prefix", "fp", "sim"])

    return docs.select(F.col("doc_id").cast("long"), "text", _body().alias("body")).mapInArrow(
        run, "doc_id long, body long, cid long, n long, prefix array<long>, fp array<long>, sim long")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, seed: int, scratch: Scratch, name: str) -> DataFrame:
    """Of ``pairs`` (a, b), those of similarity 0.8 or more, counted over the whole sets.

    The texts asked for are written first, so that Spark knows their number before it would shuffle all texts.
    """
    cids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    bodies = scratch.put(classes.join(cids, "cid", "left_semi").select("body"), f"bodies-{name}")

    def run(batches):
        for batch in batches:
            for s in shingle_sets(batch.column(0), words, seed):
                yield pa.RecordBatch.from_arrays([pa.array([_cid(s)], pa.int64()), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], names=["cid", "s"])

    texts = docs.select("text", _body().alias("body")).join(bodies, "body", "left_semi").dropDuplicates(["body"]).select("text")
    sets = texts.mapInArrow(run, "cid long, s array<long>")
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(9 * common >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _behind(n):
    """How many shingles of a set of ``n`` follow its prefix."""
    return F.floor((4 * n + 4) / 5) - 1


def _fit(x, y):
    """Can two sets (n, k, fp) be similar? ``k``: how many of their prefix shingles are in any other prefix.

    Sets of similarity 0.8 or more share 4/9 of their summed sizes at least, so they differ in 1/9 of
    it at most, and their fingerprints too.
    """
    (na, ka, fa), (nb, kb, fb) = x, y
    most = F.least(F.least(ka, kb) + F.greatest(_behind(na), _behind(nb)), na, nb)
    apart = reduce(lambda p, q: p + q, (F.bit_count(F.get(fa, F.lit(i)).bitwiseXOR(F.get(fb, F.lit(i)))) for i in range(PARITY_BITS // 64)))
    return (9 * most >= 4 * (na + nb)) & (9 * apart <= na + nb)


def _possible(pairs: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(a, b) of (a, b, na, nb, m) that may be similar; ``m`` counts shingles that both prefixes hold.

    What two sets share lies in both prefixes or behind the one that ends first. Shingles of lists
    that were not counted here (``others``) are taken as shared.
    """
    got = pairs.groupBy("a", "b", "na", "nb").agg(F.sum("m").alias("m"))
    most = F.col("m") + F.greatest(_behind(F.col("na")), _behind(F.col("nb")))
    if others is not None:
        beyond = others.groupBy("cid").agg(F.sum("m").alias("o"))
        for side in "ab":
            got = got.join(beyond.select(F.col("cid").alias(side), F.col("o").alias(f"o{side}")), side, "left").fillna(0, [f"o{side}"])
        most = most + F.least("oa", "ob")
    return got.where(9 * most >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def simhash_pairs(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of sets of ``classes`` (cid, sim) that connect all whose SimHash differs in 2 or fewer bits.

    Sets of one fingerprint are paired with the smallest of them, and these with those of the fingerprints nearby.
    """
    first = scratch.put(classes.groupBy("sim").agg(F.min("cid").alias("first")), "sims")
    same = classes.join(first, "sim").select(F.col("first").alias("a"), F.col("cid").alias("b"))
    near = near_pairs(first.select(F.col("sim").alias("fp")), scratch)
    near = near.join(first.select(F.col("sim").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("sim").alias("b"), F.col("first").alias("y")), "b")
    return same.union(near.select(F.least("x", "y"), F.greatest("x", "y"))).where("a <> b").distinct()


def _narrowed(rows: DataFrame, scratch: Scratch, name: str, rounds: int = 2) -> DataFrame:
    """Of ``rows`` (tok, m, cid, n, fp, comp), those that a similar pair of two components may share, with ``k``.

    ``k`` counts a set's shingles that are left. A list inside one component goes, and of the others each set that has
    too few such shingles for the sizes met there. So a pair that is similar keeps all lists that it shares, and every
    round can only find more to drop. Each is written, so that its plan does not hold the rounds before.
    """
    for turn in range(rounds):
        lists = rows.groupBy("tok").agg(F.min("comp").alias("l"), F.max("comp").alias("h"), F.min("n").alias("least"), F.max("n").alias("most")).where("l <> h")
        rows = rows.drop("k").join(lists.select("tok", "least", "most"), "tok")
        rows = rows.join(rows.groupBy("cid").agg(F.sum("m").alias("k")), "cid")
        # what the pair shares at most, behind this set or, unrounded, behind the largest of the list
        own = 9 * (F.col("k") + _behind(F.col("n"))) >= 4 * (F.col("n") + F.col("least"))
        rows = rows.where(own | (45 * F.col("k") + 16 * F.col("most") - 9 >= 20 * F.col("n")))
        rows = scratch.put(rows.select("tok", "m", "cid", "n", "k", "fp", "comp"), f"{name}-{turn}")
        if turn:
            scratch.drop(f"{name}-{turn - 1}")
    return rows


def similar_components(classes: DataFrame, docs: DataFrame, scratch: Scratch, words: int, seed: int, longest: int = 8, draws=(2, 16)) -> DataFrame:
    """(node, component) of all sets of ``classes`` (cid, n, prefix, fp, sim, body) that links of similarity 0.8 or more connect.

    Pairs whose SimHash fingerprints are near are verified first. From then on only sets of different components
    meet: no SimHash radius of bounded cost holds every similar pair, and the lists of prefix shingles lose none.
    Equal lists count once, with their number. Lists of ``longest`` sets or fewer give all their pairs. For longer
    ones, every set is verified against a few of its lists (``draws`` by turn): the one with the fewest shingles of its
    own, which is the middle of a group of near copies, and some that come first in hashed orders. What is
    left after that is met in blocks, all but a list's largest component with the whole list. So no connection is lost, and a large group of near copies gives few pairs:
    it is linked through its middle, and sets too far from it to be similar to any are told by their own shingles
    (``_narrowed``). Components of before go on as stars, to which new edges are added.
    """
    group = None

    def verify(pairs, name):
        nonlocal group
        edges = scratch.put(_verified(scratch.put(pairs, f"pairs-{name}"), classes, docs, words, seed, scratch, name), f"edges-{name}")
        if group is not None:
            if edges.isEmpty():
                return
            edges = group.select(F.col("node").alias("a"), F.col("component").alias("b")).union(edges)
        group = scratch.put(connected_components(edges, scratch, f"cc-{name}"), f"components-{name}")

    def with_components(rows):
        return rows.join(group, F.col("cid") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cid")).drop("node", "component")

    def apart(name):  # pairs of short lists are all verified by now, so what is left shares none of these lists
        return _narrowed(with_components(long_), scratch, f"apart-{name}")

    def pairs_of(rows, on, deal=lambda x, y: (x, y), once=F.col("a") < F.col("b")):
        x = rows.withColumnsRenamed({"cid": "a", "n": "na", "k": "ka", "fp": "fa", "comp": "ca"})
        y = rows.drop("m").withColumnsRenamed({"cid": "b", "n": "nb", "k": "kb", "fp": "fb", "comp": "cb"})
        x, y = deal(x, y)
        fits = _fit(*(tuple(map(F.col, c)) for c in (("na", "ka", "fa"), ("nb", "kb", "fb"))))
        return x.join(y, on).where(once & (F.col("ca") != F.col("cb")) & fits).select("a", "b", "na", "nb", "m")

    verify(simhash_pairs(classes, scratch), "simhash")
    entries = classes.select("cid", "n", "fp", F.explode("prefix").alias("tok"))
    lists = entries.groupBy("tok").agg(
        F.count("*").alias("c"), F.expr("bit_xor(xxhash64(cid))").alias("s"), F.expr("bit_xor(xxhash64(1, cid))").alias("t")).where("c > 1")
    lists = lists.groupBy("c", "s", "t").agg(F.min("tok").alias("tok"), F.count("*").alias("m")).select("tok", "c", "m")
    met = scratch.put(entries.join(lists, "tok"), "met")
    often = met.groupBy("cid").agg(F.sum("m").alias("k"))
    members = scratch.put(met.join(often, "cid").select("tok", "c", "m", "cid", "n", "k", "fp"), "members")
    scratch.drop("met")
    short, long_ = members.where(F.col("c") <= longest), members.where(F.col("c") > longest)
    verify(_possible(pairs_of(with_components(short).drop("c"), ["tok"]), long_), "short")
    rest = apart("short")
    for turn, many in enumerate(draws):
        if rest.isEmpty():
            return group
        own = F.col("n") - _behind(F.col("n")) - F.col("k")
        drawn = lambda j: F.min(F.struct(
            (F.lit(0) if j else own).alias("own"), F.xxhash64(F.lit(turn), F.lit(j), "cid").alias("h"), "cid", "comp", "n", "k", "fp"))  # noqa: B023
        first = rest.groupBy("tok").agg(F.array(*(drawn(j).cast(
            "struct<own:long,h:long,cid:long,comp:long,n:long,k:long,fp:array<long>>") for j in range(many))).alias("f"))
        near = F.filter("f", lambda f: (f["comp"] != F.col("comp")) & _fit((F.col("n"), F.col("k"), F.col("fp")), (f["n"], f["k"], f["fp"])))
        beside = rest.join(first, "tok").select("cid", F.transform(near, lambda f: f["cid"]).alias("o"))
        beside = beside.groupBy("cid").agg(F.slice(F.array_distinct(F.flatten(F.collect_list("o"))), 1, many).alias("o")).select("cid", F.explode("o").alias("o"))
        verify(beside.select(F.least("cid", "o").alias("a"), F.greatest("cid", "o").alias("b")).distinct(), f"turn-{turn}")
        rest = apart(f"turn-{turn}")
    if rest.isEmpty():
        return group

    # a pair of two components has a set outside the list's largest one: only such sets go into every block
    largest = rest.groupBy("tok", "comp").agg(F.count("*").alias("c")).groupBy("tok").agg(
        F.max(F.struct("c", "comp"))["comp"].alias("main"), F.ceil(F.sum("c") / 128).cast("int").alias("parts"))
    rest = rest.join(largest, "tok").withColumn("minor", F.col("comp") != F.col("main")).drop("main")

    def blocks(x, y):
        dealt = x.withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
        every = y.where("minor").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return dealt.drop("parts"), every.drop("parts", "minor")

    met = pairs_of(rest, ["tok", "part"], blocks, (F.col("a") < F.col("b")) | ~F.col("minor"))
    turned = lambda p, q: F.when(F.col("a") < F.col("b"), F.col(p)).otherwise(F.col(q))
    verify(_possible(met.select(*(turned(p, q).alias(p) for p, q in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"))), "m")), "long")
    return group


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = 5, seed: int = 42, longest: int = 8) -> DataFrame:
    """(doc_id, body, component, component_id) of every row of ``docs``; body is a hash of the text.

    Texts link if the sets of their shingles of ``words`` words have a Jaccard similarity of 0.8 or
    more, counted exactly; words are those of ``simhash``. component_id is the smallest doc_id
    reachable. Texts of equal sets are one class (null and texts without words together), and are
    never expanded into pairs. A null doc_id is a component's smallest only if all are null.
    """
    counts = docs.sparkSession.sparkContext.broadcast(_shingle_counts(docs, words, seed))
    marked = scratch.put(_marked(docs, counts, words, seed), "marked")
    classes = scratch.put(marked.groupBy("cid").agg(
        F.min("doc_id").alias("least"), F.min("body").alias("body"), *(F.first(c).alias(c) for c in ("n", "prefix", "fp", "sim"))), "sets")
    group = similar_components(classes, docs, scratch, words, seed, longest)
    named = classes.join(group, F.col("cid") == F.col("node"), "left").select("cid", "least", F.coalesce("component", "cid").alias("component"))
    named = scratch.put(named, "named")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    final = named.join(ids, "component").select("cid", "component", "component_id")
    return marked.join(final, "cid").select("doc_id", "body", "component", "component_id")
