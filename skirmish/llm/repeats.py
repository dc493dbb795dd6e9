"""Path pieces of repeated windows, shared by the substring operators.

A window is ``length`` consecutive symbols (words or bytes) of one text. Each
window has an anchor: its smallest (then leftmost) ``seed``-symbol hash. Runs of
consecutive windows with one anchor are a *piece*; equal windows have equal
anchors at the same place, so equal texts are cut into equal pieces and only
pieces with a common anchor can hold a common window. Equal pieces that occur
twice are repeated as a whole; of the others only those that share an anchor
and enough context with another piece are left open for the exact method of
the operator (k-mer edges, suffix sorting).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm import words as W
from skirmish.llm.common import BlockedBloom, mix64, stored

FILTER_BLOCKS = 1 << 18
BLOCK = 1 << 20         # bytes of a block (one text may be longer)
SEGMENT = 1 << 20       # windows of a block that are handled at once
assert SEGMENT < 1 << 23


@dataclass(frozen=True)
class Symbols:
    """What a text consists of: ``words`` (else bytes), the window and the seed."""
    words: bool
    length: int
    seed: int

    def of(self, buf: np.ndarray, off: np.ndarray):
        """(hash per symbol, index of each document's first symbol and the end)."""
        if not self.words:
            return W.EXACT[buf], off
        s, e, doc = W.spans(buf, off)
        return W.word_hashes(buf, s, e), W.word_bounds(doc, len(off) - 1)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of v[i:i + width] for every i that has so many."""
    size, out = 1, v
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:len(v) - width + 1], out[width - size:][:len(v) - width + 1]) if size < width else out


def hash_range(h: np.ndarray):
    """Function (starts, ends) → hashes of symbol ranges of one block."""
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * W.powers(len(h)), out=total[1:])
    inv = W.powers(len(h) + 1, inverse=True)
    return lambda s, e: mix64((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64))


def pieces(h: np.ndarray, first: np.ndarray, sym: Symbols, segment: int = SEGMENT):
    """(document, start, number of windows, anchor place, anchor hash, content
    hash) of all pieces of a block; places count from the block's start. At most
    about ``segment`` windows are handled at once, however long a text is."""
    n, a, found = len(h) - sym.length + 1, 0, []
    width = sym.length - sym.seed + 1              # a piece has at most so many windows
    segment = max(segment, 2 * width)
    while a < n:
        z = min(a + segment, n)
        part = _segment_pieces(h[a:z + sym.length - 1], np.arange(a, z), first, sym)
        if z < n and len(part[1]) and part[1][-1] > a:
            # the last piece may go on: the next segment starts with it
            z = int(part[1][-1])
            part = [c[:-1] for c in part]
        a = z
        found.append(part)
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _segment_pieces(h: np.ndarray, start: np.ndarray, first: np.ndarray, sym: Symbols) -> list[np.ndarray]:
    a = int(start[0])
    ranged = hash_range(h)
    at = np.arange(len(h) - sym.seed + 1)
    seeds = ranged(at, at + sym.seed)
    # hash in the upper 40 bits, place in the segment below: the minimum is the leftmost one
    low = sliding_min((seeds & ~np.uint64((1 << 24) - 1)) | (at.astype(np.uint64) & np.uint64((1 << 24) - 1)), sym.length - sym.seed + 1)
    place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    doc = np.searchsorted(first, start, side="right") - 1
    own = start + sym.length <= first[1:][doc]
    doc, start, place = doc[own], start[own], place[own]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    cut = np.flatnonzero(new)
    count = np.diff(np.append(cut, len(start)))
    s = start[cut]
    return [doc[cut], s, count, place[cut] + a, seeds[place[cut]], ranged(s - a, s - a + count - 1 + sym.length)]


SCAN = "doc_id long, tkey long, n long, sha string, anchors array<long>, contents array<long>, starts array<int>, counts array<int>, places array<int>"
SCAN_ARROW = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("n", pa.int64()), ("sha", pa.string()), ("anchors", pa.list_(pa.int64())),
                        ("contents", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("places", pa.list_(pa.int32()))])


def kept_bytes(raw: bytes, sym: Symbols) -> bytes:
    """The whole text as kept symbols: words joined by a space, or its bytes."""
    return b" ".join(raw.split()) if sym.words else raw


def _scan(sym: Symbols):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0), b.column(1)
            for i, j, buf, off in W.blocks(b.column(2), BLOCK):
                h, first = sym.of(buf, off)
                doc, start, count, place, anchor, content = pieces(h, first, sym)
                cut = pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32))
                raw = buf.tobytes()
                sha = [hashlib.sha256(kept_bytes(raw[a:z], sym)).hexdigest() for a, z in zip(off.tolist(), off[1:].tolist(), strict=False)]

                def lists(v, kind, cut=cut):
                    return pa.ListArray.from_arrays(cut, pa.array(v, kind))

                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, j - i), keys.slice(i, j - i), pa.array(np.diff(first), pa.int64()), pa.array(sha), lists(anchor.view(np.int64), pa.int64()),
                    lists(content.view(np.int64), pa.int64()), lists((start - first[doc]).astype(np.int32), pa.int32()),
                    lists(count.astype(np.int32), pa.int32()), lists((place - start).astype(np.int32), pa.int32())], schema=SCAN_ARROW)
    return run


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("tkey"), "text")


def wanted_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tkey, text), once each, of the texts whose key is in ``wanted`` (tkey);
    a filter of fixed size spares the others the shuffle."""
    held = rows.sparkSession.sparkContext.broadcast(BlockedBloom.build(wanted, "tkey", FILTER_BLOCKS))

    @F.pandas_udf("boolean")
    def may(k: pd.Series) -> pd.Series:
        return pd.Series(held.value.may_hold(k.to_numpy("int64")))

    return rows.select("tkey", "text").where(may("tkey")).join(wanted, "tkey", "left_semi").groupBy("tkey").agg(F.first("text").alias("text"))


class Found:
    """Pieces of all texts: ``scanned`` (a row per document), ``whole`` (tkey,
    start, size in symbols: repeated as a whole) and ``open`` (piece, tkey,
    start, count, place, anchor: pieces that occur once, or the stand-ins of
    repeated ones, which share an anchor with a piece that occurs once)."""

    def __init__(self, rows: DataFrame, sym: Symbols):
        self.sym = sym
        self.scanned = stored(rows.mapInArrow(_scan(sym), SCAN), "pieces")
        # equal texts are one text with a number of copies
        self.texts = stored(self.scanned.groupBy("tkey").agg(
            F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("anchors", "contents", "starts", "counts", "places")]), "texts")
        # copies of a piece inside one text are counted before the shuffle
        spread = self.texts.select("tkey", "copies", F.explode(F.arrays_zip("anchors", "contents", "starts", "counts", "places")).alias("p")).select(
            "tkey", "copies", F.col("p.anchors").alias("anchor"), F.col("p.contents").alias("content"), F.col("p.starts").alias("start"),
            F.col("p.counts").alias("count"), F.col("p.places").alias("place"))
        kinds = stored(spread.groupBy("anchor", "content").agg(
            F.sum("copies").alias("n"), F.min(F.struct("tkey", "start", "count", "place")).alias("one")), "kinds")
        many = stored(kinds.where("n > 1").select("content"), "repeated-pieces")
        held = rows.sparkSession.sparkContext.broadcast(BlockedBloom.build(many, "content", 4 * FILTER_BLOCKS))

        @F.pandas_udf("boolean")
        def may(k: pd.Series) -> pd.Series:
            return pd.Series(held.value.may_hold(k.to_numpy("int64")))

        # texts with copies go as a whole and need no coordinates
        self.whole = (spread.where("copies = 1").select("tkey", "start", (F.col("count") - 1 + sym.length).alias("size"), "content")
                      .where(may("content")).join(many, "content", "left_semi").select("tkey", "start", "size"))
        shared = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select("anchor")
        self.open = stored(kinds.join(shared, "anchor").select(
            F.xxhash64("anchor", "content").alias("piece"), "one.*", "anchor", "n"), "open-pieces")


CONTEXT = "piece long, k long"
CONTEXT_ARROW = pa.schema([("piece", pa.int64()), ("k", pa.int64())])
OPEN = "array<struct<start:int,count:int,place:int,piece:long,anchor:long,n:long>>"


def per_text(rows: DataFrame, open_pieces: DataFrame) -> DataFrame:
    """(tkey, text, pieces): the texts of open pieces with the list of them
    (bounded by the text's own length)."""
    listed = stored(open_pieces.groupBy("tkey").agg(F.sort_array(F.collect_list(F.struct("start", "count", "place", "piece", "anchor", "n"))).alias("pieces")), "open-by-text")
    return stored(wanted_texts(rows, listed.select("tkey")).join(listed, "tkey").select("tkey", "text", "pieces"), "open-texts")


def _contexts(sym: Symbols):
    """Two keys per piece: what follows its anchor's start, what precedes it. A
    common window holds at least one of them as a whole."""
    right = (sym.length + sym.seed) // 2
    left = sym.length - right

    def run(batches):
        for b in batches:
            out_p, out_k = [], []
            for text, listed in zip(b.column(1), b.column(2), strict=True):
                buf = np.frombuffer(text.as_py().encode(), np.uint8)
                h, _ = sym.of(buf, np.array([0, len(buf)]))
                ranged = hash_range(h)
                p = listed.values
                at = (p.field("start").to_numpy().astype(np.int64) + p.field("place").to_numpy())
                piece, anchor = p.field("piece").to_numpy(), p.field("anchor").to_numpy().view(np.uint64)
                ok = at + right <= len(h)
                out_p.append(piece[ok])
                out_k.append(ranged(at[ok], at[ok] + right) ^ anchor[ok])
                ok = at >= left + 1
                out_p.append(piece[ok])
                out_k.append(mix64(ranged(at[ok] - left - 1, at[ok]) ^ anchor[ok]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_p) if out_p else [], pa.int64()),
                                              pa.array(np.concatenate(out_k).view(np.int64) if out_k else [], pa.int64())], schema=CONTEXT_ARROW)
    return run


def narrowed(texts: DataFrame, sym: Symbols) -> DataFrame:
    """Pieces (piece) that share a context key with another piece."""
    keys = stored(texts.mapInArrow(_contexts(sym), CONTEXT), "contexts")
    common = stored(keys.groupBy("k").agg(F.min("piece").alias("x"), F.max("piece").alias("y")).where("x <> y").select("k"), "common-contexts")
    return stored(keys.join(common, "k", "left_semi").select("piece").distinct(), "narrowed-pieces")


WINDOWS = "tkey long, at int, window long, n long"
WINDOWS_ARROW = pa.schema([("tkey", pa.int64()), ("at", pa.int32()), ("window", pa.int64()), ("n", pa.int64())])


def window_rows(sym: Symbols):
    """(tkey, text, pieces) → a row per window of the listed pieces."""
    def run(batches):
        for b in batches:
            cols = [[], [], [], []]
            for key, text, listed in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                buf = np.frombuffer(text.as_py().encode(), np.uint8)
                h, _ = sym.of(buf, np.array([0, len(buf)]))
                p = listed.values
                count = p.field("count").to_numpy().astype(np.int64)
                first = np.cumsum(count) - count
                at = np.arange(count.sum()) + np.repeat(p.field("start").to_numpy() - first, count)
                cols[0].append(np.full(len(at), key))
                cols[1].append(at.astype(np.int32))
                cols[2].append(hash_range(h)(at, at + sym.length).view(np.int64))
                cols[3].append(np.repeat(p.field("n").to_numpy(), count))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(cols, WINDOWS_ARROW, strict=True)], schema=WINDOWS_ARROW)
    return run


RESULT = "tkey long, n_removed long, n_spans long, kept_sha256 string"
RESULT_ARROW = pa.schema([("tkey", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _cut(sym: Symbols):
    def run(batches):
        for b in batches:
            out = []
            for key, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                raw = text.as_py().encode()
                buf = np.frombuffer(raw, np.uint8)
                if sym.words:
                    s, e, _ = W.spans(buf, np.array([0, len(buf)]))
                    n = len(s)
                else:
                    n = len(buf)
                start, size = spans.values.field("start").to_numpy().astype(np.int64), spans.values.field("size").to_numpy().astype(np.int64)
                edge = np.bincount(start, minlength=n + 1) - np.bincount(start + size, minlength=n + 1)
                gone = np.cumsum(edge)[:n] > 0
                if sym.words:
                    kept = b" ".join([raw[a:z] for a, z in zip(s[~gone].tolist(), e[~gone].tolist(), strict=True)])
                else:
                    kept = buf[~gone].tobytes()
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (n > 0 and gone[0]))
                out.append({"tkey": key, "n_removed": int(gone.sum()), "n_spans": runs, "kept_sha256": hashlib.sha256(kept).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=RESULT_ARROW)
    return run


def removed(rows: DataFrame, found: Found, extra: DataFrame) -> DataFrame:
    """One row per document: doc_id, n, n_removed, n_spans, kept_sha256. ``extra``
    (tkey, start, size) are the spans that the operator found in open pieces."""
    sym = found.sym
    empty = hashlib.sha256(b"").hexdigest()
    spans = found.whole.unionByName(extra).groupBy("tkey").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    spans = stored(spans.join(found.texts.where("copies = 1").select("tkey"), "tkey", "left_semi"), "spans")
    cut = stored(wanted_texts(rows, spans.select("tkey")).join(spans, "tkey").select("tkey", "text", "spans").mapInArrow(_cut(sym), RESULT), "cut")
    copied = stored(found.texts.where("copies > 1").select("tkey", F.lit(True).alias("copied")), "copied")
    whole = F.col("copied").isNotNull() & (F.col("n") >= sym.length)
    return (found.scanned.select("doc_id", "tkey", "n", "sha").join(copied, "tkey", "left").join(cut, "tkey", "left")
            .select("doc_id", "n", F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                    F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                    F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")))
