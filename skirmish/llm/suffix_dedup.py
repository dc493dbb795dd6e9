"""Suffix-array dedup by a difference cover.

Bytes covered by a repeated string of ``length`` bytes are found by ordering
sampled suffixes. Equal strings have equal anchors at the same place (see
``repeats``), so positions counted from the anchor need only one residue of a
period as their difference cover, where unaligned positions would need two of
three: the sample is every ``period``-th suffix. Its names are built by
tripling (a name stands for three shorter names). Names are hashes, so equal
prefixes get equal names: grouping by the hash replaces the sort of the names
and the comparison of adjacent ones, and gives the classes of equal prefixes. The suffixes between two
sampled ones are merged: where a class's surroundings are equal too, all of
them repeat with it; elsewhere they are compared by their own full prefixes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm import repeats as R
from skirmish.llm.common import mix64, read, stored

SAMPLE = "name long, around long, tkey long, low int, high int, n long, anchor long"
SAMPLE_ARROW = pa.schema([("name", pa.int64()), ("around", pa.int64()), ("tkey", pa.int64()), ("low", pa.int32()), ("high", pa.int32()),
                          ("n", pa.int64()), ("anchor", pa.int64())])


def tripled_name(ranged, at: np.ndarray, size: int) -> np.ndarray:
    """Name of the ``size`` bytes from each place: three overlapping names of a
    third of the size, down to names of at most 32 bytes."""
    if size <= 32:
        return ranged(at, at + size)
    part = -(-size // 3)
    step = (size - part) // 2
    part = size - 2 * step
    a, b, c = (tripled_name(ranged, at + k * step, part) for k in range(3))
    return mix64(a + mix64(b + mix64(c + np.uint64(size))))


def _sample(sym: R.Symbols, period: int):
    """Sampled suffixes of the listed pieces: name of the bytes that all windows
    from ``low`` to ``high`` (at most ``period``) have in common, and the hash
    of all the bytes that they cover."""
    short = sym.length - period + 1

    def run(batches):
        for b in batches:
            cols = [[] for _ in SAMPLE_ARROW]
            for key, text, listed in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                buf = np.frombuffer(text.as_py().encode(), np.uint8)
                h, _ = sym.of(buf, np.array([0, len(buf)]))
                ranged = R.hash_range(h)
                p = listed.values
                start, count = (p.field(c).to_numpy().astype(np.int64) for c in ("start", "count"))
                anchor = p.field("anchor").to_numpy().view(np.uint64)
                first = start + p.field("place").to_numpy() % period       # same residue from the anchor
                many = (start + count + period - 1 - first + period - 1) // period
                own = np.repeat(np.arange(len(start)), many)
                q = first[own] + (np.arange(len(own)) - (np.cumsum(many) - many)[own]) * period
                low, high = np.maximum(start[own], q - period + 1), np.minimum(q, (start + count)[own] - 1)
                ok = (low <= high) & (q + short <= len(h))
                own, q, low, high = own[ok], q[ok], low[ok], high[ok]
                place = (start + p.field("place").to_numpy())[own] - q
                name = tripled_name(ranged, q, short) ^ mix64(anchor[own] + place.astype(np.uint64))
                a, z = np.maximum(q - period + 1, 0), np.minimum(q + sym.length, len(h))
                around = ranged(a, z) ^ mix64((q - a).astype(np.uint64))
                for c, v in zip(cols, (name.view(np.int64), around.view(np.int64), np.full(len(q), key), low.astype(np.int32), high.astype(np.int32),
                                       p.field("n").to_numpy()[own], anchor[own].view(np.int64)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(cols, SAMPLE_ARROW, strict=True)], schema=SAMPLE_ARROW)
    return run


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, seed: int = 32,
                          period: int = 8) -> DataFrame:
    """One row per document: doc_id, n (bytes), n_removed, n_spans, kept_sha256.

    A byte is removed if a string of ``length`` bytes over it also starts
    anywhere else, in the same document too; judged on the input. Null and
    empty texts have no bytes; shorter texts lose none; repeated rows are
    copies of each other; null ids keep their rows; other columns are ignored;
    an empty table gives an empty result. Exact up to collisions of 64-bit
    hashes.
    """
    sym = R.Symbols(words=False, length=length, seed=seed)
    rows = R.text_rows(docs, id_col, text_col)
    found = R.Found(rows, sym)
    texts = R.per_text(rows, found.open)
    near = R.narrowed(texts, sym)
    texts = R.per_text(rows, found.open.join(near, "piece", "left_semi"))
    sample = stored(texts.mapInArrow(_sample(sym, period), SAMPLE), "sampled-suffixes")
    classes = stored(sample.groupBy("name").agg(F.sum("n").alias("total"), (F.min("around") == F.max("around")).alias("same"))
                     .where("total > 1").select("name", "same"), "suffix-classes")
    met = stored(sample.join(classes, "name").select("tkey", "low", "high", "n", "anchor", "same"), "suffix-members")
    whole = met.where("same AND n = 1").select("tkey", F.col("low").alias("start"), (F.col("high") - F.col("low") + length).alias("size"))
    # the suffixes between sampled ones of the other classes
    rest = met.where("NOT same").select("tkey", F.col("low").alias("start"), (F.col("high") - F.col("low") + 1).alias("count"), F.lit(0).alias("place"),
                                        F.lit(0).cast("long").alias("piece"), "anchor", "n")
    windows = stored(R.per_text(rows, rest).mapInArrow(R.window_rows(sym), R.WINDOWS), "merged-suffixes")
    again = stored(windows.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window"), "repeated-suffixes")
    single = windows.where("n = 1").join(again, "window", "left_semi").select("tkey", F.col("at").alias("start"), F.lit(length).alias("size"))
    return R.removed(rows, found, whole.unionByName(single))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(read(spark, sf_dir, "documents")).select(
        "doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
