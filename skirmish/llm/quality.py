"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded
(spelling, punctuation and repetition statistics through a learned layer),
gated attention weights the passages, and the weighted sum is scored. Only the
document's label is known in training; the passages' weights are learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm import words as W
from skirmish.llm.common import read

PASSAGE = 64
N_WORD, N_CHAR, N_HASH = 14, 44, 32
N_FEATURES = N_WORD + N_CHAR + N_HASH
SAMPLE = 3000
BLOCK_BYTES = 1 << 17          # a block's arrays take about a hundred times its bytes

# byte classes: own ones for punctuation, shared ones for letters and the rest
_CLASS = np.full(256, 0, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
for _k, _c in enumerate(b" \n\t\r.,;:!?'\"-_()[]{}<>/\\|@#$%&*+=^~`"):
    _CLASS[_c] = 5 + _k
assert _CLASS.max() < N_CHAR
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_PLAIN = _LOWER | _UPPER | (np.arange(256) >= 128)


def passages(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, first passage of each document and the end);
    a document without words has one passage of zeros."""
    n_docs = len(off) - 1
    s, e, doc = W.spans(buf, off)
    bounds = W.word_bounds(doc, n_docs)
    n_words = np.diff(bounds)
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(n_pass)])
    x = np.zeros((first[-1], N_FEATURES), dtype=np.float32)
    if len(s) == 0:
        return x, first
    at = np.arange(len(s)) - bounds[doc]
    p = first[doc] + at // PASSAGE
    total = first[-1]
    size = np.bincount(p, minlength=total).astype(np.float64)
    per = 1 / np.maximum(size, 1)

    def share(values) -> np.ndarray:
        return np.bincount(p, weights=values, minlength=total) * per

    length = (e - s).astype(np.float64)
    h = W.word_hashes(buf, s, e, W.FOLDED)
    up = np.concatenate([[0], np.cumsum(_UPPER[buf])])
    low = np.concatenate([[0], np.cumsum(_LOWER[buf])])
    plain = np.concatenate([[0], np.cumsum(_PLAIN[buf])])
    n_up, n_low, odd = up[e] - up[s], low[e] - low[s], length - (plain[e] - plain[s])
    last = buf[e - 1]
    wide = np.minimum(length, 100)
    mean = share(wide)
    # words and pairs met again in the passage, runs of five met again in the document
    new = np.zeros(len(h))
    new[np.unique(h ^ W.mix64(p.astype(np.uint64)), return_index=True)[1]] = 1
    again = np.zeros(len(h))
    if len(h) > 5:
        starts = np.arange(len(h) - 4)
        five = W.window_sums(h, starts, starts + 5) ^ W.mix64(doc[:-4].astype(np.uint64))
        _, which, n = np.unique(five, return_inverse=True, return_counts=True)
        again[:-4] = (n[which] > 1) & (doc[:-4] == doc[4:])
    stats = [mean / 10, np.sqrt(np.maximum(0, share(wide ** 2) - mean ** 2)) / 10, share((n_up > 0) & (n_low > 0)),
             share((n_up > 0) & (n_low == 0) & (length > 1)), share((last == 46) | (last == 33) | (last == 63)), share(last == 44),
             share(odd > 1), share(odd == length), share(odd / length), share(new), share(again),
             np.log1p(size) / 5, np.log1p(np.repeat(n_words, n_pass)) / 10, np.repeat(n_words > 0, n_pass)]
    x[:, :N_WORD] = np.stack(stats, axis=1)
    # bytes go with the passage of the word before them
    owner = np.repeat(first[:-1], np.diff(off))
    k = np.cumsum(np.bincount(s, minlength=len(buf))) - 1
    ok = k >= 0
    owner[ok] = np.maximum(owner[ok], p[k[ok]])
    chars = np.bincount(owner * N_CHAR + _CLASS[buf], minlength=total * N_CHAR).reshape(total, N_CHAR)
    n_bytes = np.maximum(1, chars.sum(axis=1, keepdims=True))
    x[:, N_WORD:N_WORD + N_CHAR] = np.sqrt(chars / n_bytes)
    bucket = np.bincount(p * N_HASH + (h % np.uint64(N_HASH)).astype(np.int64), minlength=total * N_HASH).reshape(total, N_HASH)
    x[:, N_WORD + N_CHAR:] = np.sqrt(bucket * per[:, None])
    return x, first


def _sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


@dataclass
class Model:
    """Encoder, gated attention and scorer; ``constant`` replaces them where
    the labels held fewer than two classes."""
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray):
        w = self.w
        x = (x - self.mean) / self.scale
        hidden = np.maximum(0, x @ w["enc"] + w["enc_b"])
        tanh, gate = np.tanh(hidden @ w["v"]), _sigmoid(hidden @ w["u"])
        logit = (tanh * gate) @ w["att"]
        starts, bag = first[:-1], np.repeat(np.arange(len(first) - 1), np.diff(first))
        weight = np.exp(logit - np.maximum.reduceat(logit, starts)[bag])
        weight /= np.add.reduceat(weight, starts)[bag]
        pooled = np.add.reduceat(hidden * weight[:, None], starts, axis=0)
        return x, hidden, tanh, gate, bag, weight, pooled, _sigmoid(pooled @ w["out"] + w["out_b"])

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return self.forward(x, first)[-1].astype(np.float64)


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, hidden: int = 24, att: int = 12, steps: int = 400,
        rate: float = 0.01, decay: float = 1e-4) -> Model:
    """Adam on the mean log loss over whole bags."""
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(1), np.ones(1), {}, constant=float(y[0]) if len(y) else 1.0)
    rng = np.random.default_rng(7)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.02)
    d = x.shape[1]
    m = Model(mean, scale, {
        "enc": rng.normal(0, d ** -0.5, (d, hidden)), "enc_b": np.zeros(hidden), "v": rng.normal(0, hidden ** -0.5, (hidden, att)),
        "u": rng.normal(0, hidden ** -0.5, (hidden, att)), "att": rng.normal(0, att ** -0.5, att), "out": rng.normal(0, hidden ** -0.5, hidden),
        "out_b": np.zeros(1)})
    mom = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in m.w.items()}
    starts = first[:-1]
    for t in range(1, steps + 1):
        xs, hid, tanh, gate, bag, wt, pooled, p = m.forward(x, first)
        d_out = (p - y) / len(y)
        g = {"out": pooled.T @ d_out, "out_b": np.array([d_out.sum()])}
        d_pool = d_out[:, None] * m.w["out"]
        d_hid = d_pool[bag] * wt[:, None]
        d_wt = (d_pool[bag] * hid).sum(axis=1)
        d_logit = wt * (d_wt - np.add.reduceat(wt * d_wt, starts)[bag])
        g["att"] = (tanh * gate).T @ d_logit
        d_tg = d_logit[:, None] * m.w["att"]
        d_v, d_u = d_tg * gate * (1 - tanh ** 2), d_tg * tanh * gate * (1 - gate)
        g["v"], g["u"] = hid.T @ d_v, hid.T @ d_u
        d_hid = (d_hid + d_v @ m.w["v"].T + d_u @ m.w["u"].T) * (hid > 0)
        g["enc"], g["enc_b"] = xs.T @ d_hid, d_hid.sum(axis=0)
        step = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for k, v in m.w.items():
            a, b = mom[k]
            grad = g[k] + decay * v
            a += 0.1 * (grad - a)
            b += 0.01 * (grad ** 2 - b)
            v -= step * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.99 ** t)) + 1e-8)
    return m


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


FEATURES_ARROW = pa.schema([("y", pa.int32()), ("n", pa.int64()), ("x", pa.binary())])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        y, out = b.column(0).to_pylist(), []
        for i, j, buf, off in W.blocks(b.column(1), BLOCK_BYTES):
            x, first = passages(buf, off)
            out += [{"y": y[k], "n": int(first[k - i + 1] - first[k - i]), "x": x[first[k - i]: first[k - i + 1]].astype(np.float16).tobytes()}
                    for k in range(i, j)]
        yield pa.RecordBatch.from_pylist(out, schema=FEATURES_ARROW)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents, the first in the order of
    their ids' hash; never on held-out ones. Null labels and ids are left out;
    a document labelled twice counts with its larger label; labels without a
    document are ignored. The sample's passages are gathered on the driver."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
             .where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
             .orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(known), "id").select("y", "text").mapInArrow(_encode, "y int, n long, x binary").collect())
    rows.sort(key=lambda r: (r["y"], bytes(r["x"])))
    x = np.concatenate([np.frombuffer(r["x"], np.float16).reshape(-1, N_FEATURES) for r in rows] or [np.zeros((0, N_FEATURES))]).astype(np.float64)
    first = np.concatenate([[0], np.cumsum([r["n"] for r in rows])]).astype(np.int64)
    return fit(x, first, np.array([r["y"] for r in rows], dtype=np.float64))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col`` (double, 0 to 1). Only the text is used; a null
    text counts as empty and is scored like one; all columns and rows stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for i, j, buf, off in W.blocks(texts, BLOCK_BYTES):
            out[i:j] = held.value.score(*passages(buf, off))
        return pa.array(out)

    return docs.withColumn(out_col, run(F.col(text_col).cast("string")))


def op9_quality(spark, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    return (score(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                      F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")))
