"""The trie of conversations' opening turns, and its subtree totals by parallel tree contraction."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.common import WORD, Scratch, by_value, lookup

by_value(__name__)

NODE = ["conv_id", "depth"]
STRETCH = 1024  #: turns of a conversation that one window numbers
CHUNK = 512  #: range of conv_ids that one piece of a list covers


def read_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, t1, t2, words) of every row with a conv_id: t1, t2 stand for role and text, null being empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("t1"), F.xxhash64(text, F.lit(1), role).alias("t2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def number_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with ``at``, from 1 per conversation by turn (null first); rows of one turn in the order of their hashes.

    A conversation may be most of the table, so its turns are numbered inside ranges a thousandth of the
    turn wide, and ranges by their totals. Rows of one turn are one task's work.
    """
    t = F.col("turn").cast("double")
    scale = F.when(t.isNull() | F.isnan(t), F.lit(-(1 << 20))).otherwise(F.floor(F.signum(t) * F.log1p(F.abs(t)) * STRETCH)).cast("int")
    dealt = turns.withColumn("range", scale)
    order = [F.col("turn").asc_nulls_first(), "t1", "t2"]
    inside = Window.partitionBy("conv_id", "range").orderBy(*order)
    sizes = dealt.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range")) - F.col("n")
    numbered = dealt.withColumn("place", F.row_number().over(inside)).join(sizes.withColumn("before", before).drop("n"), ["conv_id", "range"])
    return numbered.select("conv_id", (F.col("place") + F.col("before")).alias("at"), "t1", "t2", "words")


def openings(numbered: DataFrame, every: int, modulus: int) -> DataFrame:
    """One row per conversation: h, the borrowed turns, the shift of its own later turns, its final number of turns."""
    c = F.col("conv_id")
    head = F.sort_array(F.collect_list(F.when(F.col("at") < modulus, F.struct("at", "t1", "t2", "words"))))  # modulus - 1 turns at most
    convs = numbered.groupBy("conv_id").agg(F.count("*").alias("n"), head.alias("head")).withColumns({
        "h": F.pmod(F.crc32(c.cast("string")), F.lit(modulus)).cast("int"), "base": c - c % every})
    bases = convs.where(c % every == 0).select(c.alias("base"), F.col("head").alias("from"))
    both = convs.join(bases, "base", "left")
    taken = F.slice(F.coalesce("from", F.array().cast(convs.schema["head"].dataType)), F.lit(1), F.col("h"))
    both = both.withColumn("opening", taken).withColumn("shift", F.size("opening") - F.col("h"))
    return both.select("conv_id", "n", "h", "opening", "shift", (F.size("opening") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns"))


def running_xor(rows: DataFrame, values: dict[str, str]) -> DataFrame:
    """``rows`` (conv_id, at from 1 without gaps, ...) and for each value its running exclusive or, under its new name."""
    dealt = rows.withColumn("stretch", F.expr(f"at div {STRETCH}"))
    inside = Window.partitionBy("conv_id", "stretch").orderBy("at")
    upto = Window.partitionBy("conv_id").orderBy("stretch")
    ends = dealt.groupBy("conv_id", "stretch").agg(*(F.bit_xor(v).alias(f"total_{v}") for v in values))
    ends = ends.select("conv_id", "stretch", *(F.bit_xor(f"total_{v}").over(upto).bitwiseXOR(F.col(f"total_{v}")).alias(f"before_{v}") for v in values))
    found = dealt.withColumns({f"inside_{v}": F.bit_xor(v).over(inside) for v in values}).join(ends, ["conv_id", "stretch"])
    return found.select(*rows.columns, *(F.col(f"inside_{v}").bitwiseXOR(F.col(f"before_{v}")).alias(name) for v, name in values.items()))


def _list_digests(batches):
    """SHA-256 per key of its chunks joined by commas; chunks come sorted by key, in the list's order."""
    key, state = None, None
    for batch in batches:
        done = []
        *keys, chunks = (c.to_pylist() for c in batch.columns)
        for *k, chunk in zip(*keys, chunks):
            if k != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(chunk.encode())
        yield done
    yield [] if key is None else [(*key, state.hexdigest())]


def list_digests(ids: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ascending distinct ``value``s of each key, in decimal, joined by commas.

    Ids of one range of ``CHUNK`` are joined first, so the pass over a hot key, which the hash's chaining
    asks for, streams over few rows and holds one at a time.
    """
    chunk = F.floor(F.col(value) / CHUNK).alias("chunk")
    chunks = ids.groupBy(*key, chunk).agg(F.array_join(F.sort_array(F.collect_list(value)), ",").alias("ids"))

    def run(batches):
        for done in _list_digests(batches):
            if done:
                *keys, digest = zip(*done)
                yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), pa.array(digest)], names=[*key, "ends_sha256"])

    return chunks.repartition(*key).sortWithinPartitions(*key, "chunk").select(*(F.col(k).cast("long") for k in key), "ids").mapInArrow(
        run, ", ".join(f"{k} long" for k in key) + ", ends_sha256 string")


def _rank(step: int, depth: Column, *ids: str) -> Column:
    """Rank by which chain nodes leave: in even rounds trailing zeros of the depth, then and in odd rounds a hash."""
    low = F.when(depth > 0, depth.bitwiseAND(-depth)).otherwise(F.lit((1 << 63) - 1)) if step % 2 == 0 else F.lit(0).cast("long")
    return F.struct(low.alias("low"), F.xxhash64(F.lit(step), *ids).alias("mix"), *(F.col(i).alias(f"id{n}") for n, i in enumerate(ids)))


def subtree_sums(tree: DataFrame, values: list[str], scratch: Scratch) -> DataFrame:
    """(conv_id, depth, values): sums over each node's subtree, the node included, of its own ``values``.

    ``tree`` is (conv_id, depth, parent_conv_id, n_children, values): a node is named by the first two, its
    parent by parent_conv_id and the depth before. Rounds of joins contract it until nothing is left:
    rake takes every leaf away and adds its sums to its parent, they being final; compress takes away
    nodes with one remaining child, which then hangs below the next node up, to which what the node had is
    added. Those leave whose rank is below both neighbours', so no two adjacent ones do: half of a long
    chain in even rounds, a third of any in odd ones. So rounds grow with the logarithm of the size, whatever
    the height. Rounds backwards then give each compressed node what it had plus its child's total.
    """
    up = ["up_id", "up_depth"]
    here = tree.select(*NODE, F.col("parent_conv_id").alias("up_id"), (F.col("depth") - 1).alias("up_depth"), F.col("n_children").alias("k"), *values)
    trees, inners = [scratch.put(here, "tree-0")], []
    while not trees[-1].isEmpty():
        here, step, leaf = trees[-1], len(inners), F.col("k") == 0
        kids = here.groupBy(*up).agg(
            *(F.sum(F.when(leaf, F.col(v)).otherwise(0)).alias(f"raked_{v}") for v in values),
            F.count_if(~leaf).alias("rest"), F.min(F.when(~leaf, F.struct(*NODE))).alias("only"))
        inner = here.where(~leaf).join(kids.withColumnsRenamed(dict(zip(up, NODE))), NODE).select(
            *NODE, *up, F.col("rest").alias("k"), *((F.col(v) + F.col(f"raked_{v}")).alias(v) for v in values),
            F.col("only.conv_id").alias("only_id"), F.col("only.depth").alias("only_depth"))
        mine, below, above = (_rank(step, F.col(i[1]), *i) for i in (NODE, ["only_id", "only_depth"], up))
        leaves = (F.col("k") == 1) & F.col("up_id").isNotNull() & (mine < above) & (mine < below)
        inners.append(scratch.put(inner.withColumn("gone", leaves), f"inner-{step}"))
        gone, stay = inners[-1].where("gone"), inners[-1].where("not gone")
        moved = gone.select(F.col("only_id").alias("conv_id"), F.col("only_depth").alias("depth"), F.col("up_id").alias("to_id"), F.col("up_depth").alias("to_depth"))
        added = gone.groupBy(*up).agg(*(F.sum(v).alias(f"more_{v}") for v in values)).withColumnsRenamed(dict(zip(up, NODE)))
        rest = stay.join(moved, NODE, "left").join(added, NODE, "left").select(
            *NODE, F.coalesce("to_id", "up_id").alias("up_id"), F.coalesce("to_depth", "up_depth").alias("up_depth"), "k",
            *((F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values))
        trees.append(scratch.put(rest, f"tree-{step + 1}"))
    done = trees[-1].select(*NODE, *values)
    for step in reversed(range(len(inners))):
        child = done.select(F.col("conv_id").alias("only_id"), F.col("depth").alias("only_depth"), *(F.col(v).alias(f"total_{v}") for v in values))
        total = inners[step].where("gone").join(child, ["only_id", "only_depth"]).select(*NODE, *((F.col(v) + F.col(f"total_{v}")).alias(v) for v in values))
        done = scratch.put(done.unionByName(total).unionByName(trees[step].where("k = 0").select(*NODE, *values)), f"done-{step}")
    return done


def prefix_trie(conversations: DataFrame, scratch: Scratch, every: int = 20, modulus: int = 4) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, with its totals, as ``op12`` states them.

    A conversation is its rows by turn, null first; rows of one turn come in the order of hashes of role and
    text, so equal rows are told apart by nothing and each counts. Null role and text are empty, rows
    without a conv_id belong to no conversation, other columns are not read. Conversation c starts with
    the first h = crc32(c) % ``modulus`` turns of c - c % ``every``, where there is one, and goes on with its own after
    its first h. An empty table has no nodes, not even a root.

    A turn counts as two 64-bit hashes; an opening as the exclusive or of its turns' hashes, each with its
    place. A node's name is its smallest member and its depth.
    """
    turns = scratch.put(read_turns(conversations), "turns")
    numbered = scratch.put(number_turns(turns), "numbered")
    convs = scratch.put(openings(numbered, every, modulus), "convs")
    heavy = F.col("n") > F.lit(numbered.count() / 1000)
    own = lookup(numbered, convs.drop("opening"), ["conv_id"], heavy).where("at > h").select("conv_id", (F.col("at") + F.col("shift")).alias("at"), "turns", "t1", "t2", "words")
    lent = convs.select("conv_id", "turns", F.posexplode("opening").alias("pos", "o")).select(
        "conv_id", (F.col("pos") + 1).cast("long").alias("at"), "turns", "o.t1", "o.t2", "o.words")
    rebuilt = own.unionByName(lent).select(
        "conv_id", "at", (F.col("at") == F.col("turns")).alias("last"), "words", F.xxhash64("at", "t1", "t2").alias("g1"), F.xxhash64("t2", "at", "t1").alias("g2"))
    placed = scratch.put(running_xor(rebuilt, {"g1": "x1", "g2": "x2"}), "placed")

    key, above = ["depth", "x1", "x2"], ["up_depth", "y1", "y2"]
    nodes = placed.groupBy(F.col("at").alias("depth"), "x1", "x2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
        F.min(F.col("x1").bitwiseXOR(F.col("g1"))).alias("y1"), F.min(F.col("x2").bitwiseXOR(F.col("g2"))).alias("y2"))
    none = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        none.alias("depth"), none.alias("x1"), none.alias("x2"), "conv_id", "n_convs", none.alias("words"), none.alias("y1"), none.alias("y2"))
    nodes = scratch.put(nodes.unionByName(root).withColumn("up_depth", F.col("depth") - 1), "nodes")
    kids = nodes.groupBy(*above).agg(F.count("*").alias("n_children")).withColumnsRenamed(dict(zip(above, key)))
    full = scratch.put(nodes.join(kids, key, "left").na.fill(0, ["n_children"]), "full")
    parents = full.select(*(F.col(k).alias(a) for k, a in zip(key, above)), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    linked = lookup(full, parents, above, F.col("siblings") > F.lit(full.count() / 1000)).drop("siblings")
    tree = scratch.put(linked.unionByName(full.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))), "tree")

    own_sums = tree.select(*NODE, "parent_conv_id", "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                           ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = subtree_sums(own_sums, ["n_leaves", "saved_tokens"], scratch)
    ends = placed.where("last").select(F.col("at").alias("depth"), "x1", "x2", "conv_id").unionByName(
        convs.where("turns = 0").select(none.alias("depth"), none.alias("x1"), none.alias("x2"), "conv_id"))
    digests = list_digests(ends, key, "conv_id")
    return tree.join(digests, key, "left").join(sums, NODE).select(
        *NODE, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
