"""Quality classifier: gated-attention multiple-instance learning over the passages of a text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.llm.common import by_value

by_value(__name__)

PASSAGE = 512  # bytes
PAIRS, GRAMS = 128, 1024  # hashed byte pairs; buckets that count distinct 8-byte grams
CLASSES = 9


def _class_of_byte() -> np.ndarray:
    kind = np.zeros(256, np.int64)  # 0: other control
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1] = 1, 2, 3
    kind[ord(" ")], kind[10], kind[128:] = 4, 5, 6
    kind[[ord(c) for c in ".,;:!?'\"()-"]] = 7
    kind[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 8
    return kind


def encode_passages(texts: list[bytes]):
    """(features of every passage, passages of each text). A text has one passage at least.

    Features: logarithms of hashed byte-pair counts, shares of byte classes, share of distinct grams
    and the passage's length. Passages are ``PASSAGE`` bytes; a short rest is one too.
    """
    lens = np.array([len(t) for t in texts], np.int64)
    per = np.maximum(1, -(-lens // PASSAGE))
    total = int(per.sum())
    raw = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), lens)
    place = np.arange(len(raw)) - np.repeat(np.cumsum(lens) - lens, lens)
    passage = (np.cumsum(per) - per)[owner] + place // PASSAGE
    size = np.bincount(passage, minlength=total)
    pair_bucket = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)).astype(np.int64)
    inside = (passage[1:] == passage[:-1]) if len(raw) else np.zeros(0, bool)
    pair = pair_bucket[raw[:-1].astype(np.int64) << 8 | raw[1:]]
    pairs = np.bincount((passage[:-1] * PAIRS + pair)[inside], minlength=total * PAIRS).reshape(total, PAIRS)
    kinds = np.bincount(passage * CLASSES + _class_of_byte()[raw], minlength=total * CLASSES).reshape(total, CLASSES)
    distinct = np.zeros(total)
    if len(raw) >= 8:
        eight = np.ndarray(len(raw) - 7, "<u8", raw.tobytes(), strides=(1,))
        bucket = ((eight * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
        whole = passage[7:] == passage[:-7]
        distinct = (np.bincount((passage[:-7] * GRAMS + bucket)[whole], minlength=total * GRAMS).reshape(total, GRAMS) > 0).sum(1)
    some = np.maximum(size, 1)[:, None]
    # Expected distinct buckets of as many random grams: short passages are judged on the same scale.
    fair = GRAMS * (1 - np.exp(-np.maximum(size - 7, 0) / GRAMS)) + 1
    return np.concatenate([
        np.log1p(pairs * (PASSAGE / some)), kinds / some, (distinct / fair)[:, None], np.log1p(size)[:, None],
    ], axis=1).astype(np.float32), per


def encode_texts(texts: list[bytes], most: int = 1 << 20):
    """``encode_passages`` with arrays of about ``most`` bytes of text at a time: a long text is cut between passages."""
    most = max(PASSAGE, most // PASSAGE * PASSAGE)
    if sum(map(len, texts)) <= most:
        return encode_passages(texts)
    parts = [[encode_passages([text[at : at + most]])[0] for at in range(0, max(1, len(text)), most)] for text in texts]
    return np.concatenate([p for ps in parts for p in ps]), np.array([sum(map(len, ps)) for ps in parts], np.int64)


def _segments(per):
    return np.cumsum(per) - per


@dataclass
class Attention:
    """Weights of the encoder, the gated attention and the output."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    @classmethod
    def new(cls, x: np.ndarray, hidden: int, gate: int, seed: int) -> Attention:
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        shapes = {"E": (d, hidden), "e": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "a": (gate,), "c": (hidden,), "b": (1,)}
        w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32) if len(s) > 1 or k in "ac" else np.zeros(s, np.float32) for k, s in shapes.items()}
        return cls(x.mean(0), x.std(0) + 1e-3, w)

    def forward(self, x, per):
        w, at = self.w, _segments(per)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        logit = (v * u) @ w["a"]
        top = np.repeat(np.maximum.reduceat(logit, at), per)
        weight = np.exp(logit - top)
        weight /= np.repeat(np.add.reduceat(weight, at), per)
        z = np.add.reduceat(weight[:, None] * h, at, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"][0], -30, 30)))
        return p, (x, h, v, u, weight, z)

    def gradients(self, x, per, y, sample):
        """Gradients of the weighted log-loss."""
        w, at = self.w, _segments(per)
        p, (x, h, v, u, weight, z) = self.forward(x, per)
        out = (p - y) * sample / len(y)
        g = {"c": z.T @ out, "b": np.array([out.sum()])}
        dz = np.repeat(out[:, None] * w["c"], per, axis=0)
        along = (dz * h).sum(1)
        dlogit = weight * (along - np.repeat(np.add.reduceat(weight * along, at), per))
        dh = weight[:, None] * dz
        g["a"] = (v * u).T @ dlogit
        dv, du = dlogit[:, None] * w["a"] * u * (1 - v**2), dlogit[:, None] * w["a"] * v * u * (1 - u)
        g["V"], g["U"] = h.T @ dv, h.T @ du
        dh = (dh + dv @ w["V"].T + du @ w["U"].T) * (1 - h**2)
        g["E"], g["e"] = x.T @ dh, dh.sum(0)
        return g

    def fit(self, x, per, y, sample, epochs: int, batch: int, rate: float, decay: float, seed: int) -> None:
        """Adam over shuffled batches of documents."""
        rng, first, step = np.random.default_rng(seed), _segments(per), 0
        m, s = ({k: np.zeros_like(v, np.float64) for k, v in self.w.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for begin in range(0, len(y), batch):
                docs = order[begin : begin + batch]
                rows = np.concatenate([np.arange(first[d], first[d] + per[d]) for d in docs])
                step += 1
                for k, g in self.gradients(x[rows], per[docs], y[docs], sample[docs]).items():
                    g = g + decay * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    size = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
                    self.w[k] = (self.w[k] - size * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame, held_out, per_class: int = 3000, passages: int = 60_000, hidden: int = 32, gate: int = 16, epochs: int = 20, seed: int = 11) -> Attention | float:
    """Fit to the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality 0/1) marks, outside ``held_out``.

    The fit sees a bounded sample of labelled rows, with all their passages: of each label, ids in the order of
    a hash, ``per_class`` at most, until their texts have half of ``passages`` together. An id drawn whose
    text alone has more is passed over. Sampled rows are weighted back to their share. Ids with two labels are
    left out; of several texts of one id, the smallest is taken. Scores look at all passages. With ids of one
    label only, that label is returned as the score of every text; without any, 0.5. Other columns of
    both tables are not read.
    """
    once = labels.where(~held_out & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_high"))
    once = once.where("label = _high").select(F.col("doc_id").alias("_id"), "label")
    n = {r.label: r.n for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return float(next(iter(n))) if n else 0.5
    share = {k: min(1.0, per_class / v) for k, v in n.items()}
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("_id")), F.lit(1 << 30)) < F.when(F.col("label") == 0, int(share[0] * (1 << 30))).otherwise(int(share[1] * (1 << 30)))
    drawn = F.broadcast(once.where(draw))  # about 2 * per_class rows
    texts = docs.where("text is not null").select("doc_id", "text")
    fit = texts.join(drawn, F.col("doc_id") == F.col("_id")).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    length = F.ceil(F.greatest(F.octet_length("text"), F.lit(1)) / PASSAGE).cast("long")
    sizes = fit.select("doc_id", "label", length.alias("n"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("turn")).toPandas()  # about 2 * per_class rows
    chosen = []
    for label, rows in sizes[sizes["n"] <= passages // 2].sort_values(["turn", "doc_id"]).groupby("label"):
        took = rows[rows["n"].cumsum() <= passages // 2]
        chosen.append(took)
        share[label] *= len(took) / max(1, (sizes["label"] == label).sum())
    keep = pd.concat(chosen)["doc_id"].tolist() if chosen else []
    spark, kind = docs.sparkSession, docs.select("doc_id").schema
    fit = fit.join(F.broadcast(spark.createDataFrame([(i,) for i in keep], kind)), "doc_id", "left_semi")

    def run(batches):
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = encode_texts([text.encode()])[0]
                yield pa.RecordBatch.from_arrays([pa.array([int(label)]), pa.array([len(x)]), pa.array([x.tobytes()])], names=["y", "per", "x"])

    rows = fit.select("text", "label").mapInArrow(run, "y long, per long, x binary").toPandas().sort_values(["y", "per", "x"])
    if rows["y"].nunique() < 2:
        return float(rows["y"].iloc[0]) if len(rows) else 0.5
    y, per = rows["y"].to_numpy(np.float32), rows["per"].to_numpy()
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(int(per.sum()), -1)
    weight = np.where(y == 0, 1 / share[0], 1 / share[1]).astype(np.float32)
    model = Attention.new(x, hidden, gate, seed)
    model.fit(x, per, y, weight / weight.mean(), epochs, 64, 3e-3, 1e-4, seed)
    return model


def score(docs: DataFrame, model: Attention | float, threshold: float = 0.3, chunk: int = 1 << 19) -> DataFrame:
    """Add score (0 to 1, higher: label 1 likelier) and predicted (1 from ``threshold``) to ``docs``.

    Only ``text`` is looked at, and all of it. Null and empty texts are one passage without bytes.
    Existing columns of the added names are replaced.
    """
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts, begin, size = [(t or "").encode() for t in batch.column(at).to_pylist()], 0, 0
            for end, text in enumerate(texts, 1):
                size += len(text)
                if size < chunk and end < len(texts):
                    continue
                if isinstance(model, float):
                    p = np.full(end - begin, model)
                else:
                    p = model.forward(*encode_texts(texts[begin:end]))[0].astype(np.float64)
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])
                begin, size = end, 0

    fields = [*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return docs.mapInArrow(run, T.StructType(fields))
