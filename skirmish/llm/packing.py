"""Hierarchical multi-length packing.

Documents are tokenized and cut into whole windows of the longest tier plus a
remainder. Each remainder is routed to the smallest tier that holds it. The
longest tier is packed first and its gaps are filled from the shorter tiers,
then each shorter tier is packed into windows of its own length, with gaps
filled from the tiers below. A short window that is full is a sequence of its
own; the others go up: they are laid into windows of the longest tier. The
sequences of a tier are dealt to step groups of nearly the same number of
tokens, whole windows too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm import words as W
from skirmish.llm.common import read, stored

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
STEP = 64           # sequences of a step group
END_ID = 1
CACHE_PARTS = 600_000
BLOCK_BYTES = 1 << 19


# byte classes: 0 white space, 1 letter, 2 punctuation, 3 digit, 4 joins both sides (an apostrophe, all beyond ASCII)
_CLASS = np.full(256, 2, dtype=np.int8)
_CLASS[[32, 9, 10, 13]] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 3
_CLASS[39] = _CLASS[128:] = 4


def parts(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the runs that the tokenizer's own word
    pattern never joins: white space and changes between ASCII letters, digits
    and punctuation end a run."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    c = _CLASS[buf]
    cut = np.ones(n + 1, dtype=bool)
    cut[1:n] = (c[1:] != c[:-1]) & ((c[1:] != 4) & (c[:-1] != 4) | (c[1:] == 0) | (c[:-1] == 0))
    cut[off] = True
    starts = np.flatnonzero(cut[:-1] & (c != 0))
    ends = np.flatnonzero(cut[1:] & (c != 0)) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


class WordIds:
    """Token ids of many texts at once: each distinct part of a block is looked
    up (by its 64-bit hash, ASCII letter case folded as the tokenizer does) or
    tokenized once, and the ids of all parts are put together by one gather.
    The memory of parts is emptied when it holds ``CACHE_PARTS``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.index: dict[int, int] = {}
        self.offset, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, "<u4"), 0

    def _add(self, hashes: list[int], lengths: np.ndarray, ids: np.ndarray) -> None:
        n, k = len(self.index), len(hashes)
        if not k:
            return
        while n + k > len(self.offset):
            self.offset, self.length = np.resize(self.offset, 2 * len(self.offset)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used:self.used + len(ids)] = ids
        self.length[n:n + k] = lengths
        self.offset[n:n + k] = self.used + np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.used += len(ids)
        self.index.update(zip(hashes, range(n, n + k), strict=True))

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        run = [k for k, w in enumerate(words) if w.isalpha()]
        if run:           # each word of letters ends with the one token that ends a word
            ids = np.array(self.tokenizer.encode(" ".join([words[k] for k in run]), add_special_tokens=False).ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(run):
                self._add([hashes[k] for k in run], np.diff(stops, prepend=0), ids)
        rest = [(h, w) for h, w in zip(hashes, words, strict=True) if h not in self.index]
        if rest:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([w for _, w in rest], add_special_tokens=False)]
            self._add([h for h, _ in rest], np.array([len(x) for x in ids]), np.array([i for x in ids for i in x], dtype="<u4"))

    def encode_block(self, buf: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Ids of each text as little-endian 32-bit values."""
        s, e, doc = parts(buf, off)
        h, at, which = np.unique(W.word_hashes(buf, s, e, W.FOLDED), return_index=True, return_inverse=True)
        if len(self.index) + len(h) > CACHE_PARTS:
            self.forget()
        keys, index = h.tolist(), self.index
        new = [k for k, x in enumerate(keys) if x not in index]
        if new:
            raw, a, b = buf.tobytes(), s[at[new]].tolist(), e[at[new]].tolist()
            self._learn([keys[k] for k in new], [raw[i:j].lower().decode() for i, j in zip(a, b, strict=True)])
        slot = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))[which] if len(keys) else np.zeros(0, np.int64)
        n = self.length[slot]
        end = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(self.offset[slot] - end[:-1], n) + np.arange(end[-1])]
        first = end[W.word_bounds(doc, len(off) - 1)].tolist()
        out = [ids[i:j].tobytes() for i, j in zip(first, first[1:], strict=False)]
        if b"<|" in (raw := buf.tobytes()):     # may spell a special token, whose letter case counts
            for k in range(len(out)):
                if b"<|" in (text := raw[off[k]:off[k + 1]]):
                    out[k] = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out


_encoders: dict[str, WordIds] = {}
PIECES = "uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PIECES_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


def cut_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """(uid, doc_id, text) → pieces: whole windows and one remainder each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders.setdefault(tokenizer_path, WordIds(tokenizer_path))
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            out = []
            uids, doc_ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, _, buf, off in W.blocks(b.column(2), BLOCK_BYTES):
                for k, ids in enumerate(enc.encode_block(buf, off), i):
                    ids += end
                    n = len(ids) // 4
                    out += [(uids[k], doc_ids[k], s, min(window, n - s), zlib.crc32(ids[4 * s: 4 * (s + window)]), n) for s in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else
                                             [pa.array([], pa.int64()) for _ in PIECES_ARROW], schema=PIECES_ARROW)

    return docs.mapInArrow(run, PIECES)


class Pool:
    """Items by length, from which the longest one that fits is taken; items of
    equal length in order. A bit per length tells which lengths are left."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(lengths, kind="stable")
        sizes, first = np.unique(lengths[order], return_index=True)
        parts = np.split(order, first[1:]) if len(order) else []
        self.left = {int(n): part[::-1].tolist() for n, part in zip(sizes, parts, strict=True)}
        self.have = sum(1 << n for n in self.left)

    def longest(self, room: int) -> int:
        """The greatest length left that is at most ``room`` (0: none)."""
        return max(0, (self.have & ((1 << (room + 1)) - 1)).bit_length() - 1)

    def take(self, n: int) -> int:
        i = self.left[n].pop()
        if not self.left[n]:
            self.have ^= 1 << n
            del self.left[n]
        return i

    def windows(self, size: int, above: int) -> Iterator[tuple[list[int], int]]:
        """Windows of ``size`` as (items, tokens): each is opened by the longest
        item over ``above`` left, its gap filled with the longest that fits."""
        while (n := self.longest(size)) > above:
            items, gap = [], size
            while n > 0:
                items.append(self.take(n))
                gap -= n
                n = self.longest(gap) if gap else 0
            yield items, size - gap


def pack_lengths(lengths: np.ndarray, window: int = WINDOW, tiers=TIERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number, offset and tier of its sequence for each piece."""
    pool = Pool(lengths)
    done: list[tuple[int, list[int]]] = []
    part: list[tuple[list[int], int]] = []                  # short windows with a gap
    below = sorted((t for t in tiers if t < window), reverse=True) + [0]
    for size, low in zip([window, *below], below, strict=False):
        for items, tokens in pool.windows(size, low):
            if size == window or tokens == size:
                done.append((size, items))
            else:
                part.append((items, tokens))
    up = Pool(np.array([n for _, n in part], dtype=np.int64))
    done += [(window, [i for k in windows for i in part[k][0]]) for windows, _ in up.windows(window, 0)]
    seq, off, tier = (np.zeros(len(lengths), dtype=np.int64) for _ in range(3))
    for k, (size, items) in enumerate(done):
        n = lengths[items]
        seq[items], off[items], tier[items] = k, np.cumsum(n) - n, size
    return seq, off, tier


def step_groups(tokens: np.ndarray, tier: np.ndarray, step: int) -> np.ndarray:
    """A group for each sequence: about ``step`` of one tier, dealt there and
    back by falling length, so that the groups of a tier hold nearly the same."""
    group, base = np.empty(len(tokens), dtype=np.int64), 0
    for t in np.unique(tier):
        own = np.flatnonzero(tier == t)
        rank = np.empty(len(own), dtype=np.int64)
        rank[np.argsort(-tokens[own], kind="stable")] = np.arange(len(own))
        groups = max(1, len(own) // step)
        lap, at = rank // groups, rank % groups
        group[own] = base + np.where(lap % 2, groups - 1 - at, at)
        base += groups
    return group


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack_bucket(pdf: pd.DataFrame, step: int = STEP) -> pd.DataFrame:
    pdf = pdf.sort_values(["uid", "start"], kind="stable").reset_index(drop=True)
    seq, off, tier = pack_lengths(pdf["length"].to_numpy())
    tokens = np.bincount(seq, weights=pdf["length"])
    own = np.zeros(len(tokens), dtype=np.int64)
    own[seq] = tier
    group = step_groups(tokens, own, step)
    base = int(pdf["bucket"].iloc[0]) << 32
    return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "start": pdf["start"], "length": pdf["length"], "ids_crc32": pdf["ids_crc32"],
                         "doc_tokens": pdf["doc_tokens"], "sequence_id": base + seq, "offset": off,
                         "tier": tier.astype("int32"), "step_group": base + group[seq]})


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         bucket_rows: int = 20_000) -> DataFrame:
    """One row per piece (contract columns plus tier and step_group).

    A null or empty text is one piece of one id (the end). Null ids and repeated
    rows are documents of their own; other columns are ignored; an empty table
    gives an empty result. Texts are tokenized whole, one at a time. Whole
    windows never move; remainders are dealt by hash to buckets of about
    ``bucket_rows`` (their number grows with the input), so that packing is
    bounded per task and one source or document cannot make a bucket hot.
    ``tier`` is the length of the sequence's window; a shorter one than
    ``window`` is always full. Step groups hold sequences of one tier; whole
    windows are dealt in blocks as they are read (the last of a task is smaller).
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    pieces = stored(cut_documents(rows, tokenizer_path, window), "pieces")
    n = pieces.where(F.col("length") < window).count()
    buckets = max(1, -(-n // bucket_rows))
    rest = (pieces.where(F.col("length") < window)
            .withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("long"))
            .groupBy("bucket").applyInPandas(lambda pdf: pack_bucket(pdf), PACKED))
    row = F.monotonically_increasing_id()
    own, own_group = F.lit(1 << 62) + row, F.lit(1 << 62) + F.floor(row / STEP)
    whole = (pieces.where(F.col("length") == window).withColumn("sequence_id", own)
             .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"),
                     F.lit(window).alias("tier"), own_group.alias("step_group")))
    return whole.unionByName(rest)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), public_tokenizer())
