"""N-gram Jaccard join over count vectors in R-trees.

A document is the set of its distinct word shingles. Shingles are hashed into
groups; the group counts are a point, and the overlap of two documents is at
most the sum of the coordinates' minima. An R-tree over points prunes whole
boxes by that bound, and surviving pairs are verified on the texts.

One tree over all points would prune little (boxes of unrelated documents of
one size overlap), so the points are dealt to many small trees without losing
a link: a pair within the threshold differs in at most D shingles, so if the
shingles are hashed into more than D slices, at least one slice is the same in
both. Every slice's content is the key of one tree. Equal shingle sets are one
point; a tree only searches across components found so far, so a large group
of near copies costs a chain of pairs, not all of them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm import words as W
from skirmish.llm.common import BlockedBloom, connected_components, drop_keys, fresh, mix64, read, sorted_runs, stored

CHUNK = 512
LEAF = 16
FIRST = 16          # trees of a member by which repeated pairs are told
BLOCK_BYTES = 1 << 18        # texts hashed at once: arrays that stay in a core's cache


GROUPS = 16 << np.arange(40)


def points_of(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Points of sets (``first`` as ``shingle_sets`` gives it): a power of two of
    groups (about one shingle in each on average), one byte a group; what goes
    beyond 255 in a group is summed in front, so that the bound stays an upper
    bound."""
    size = np.diff(first)
    if not len(size):
        return []
    groups = GROUPS[np.searchsorted(GROUPS * 3, size * 2)]
    base = np.cumsum(groups) - groups
    n = np.bincount(((h >> np.uint64(20)).astype(np.int64) & np.repeat(groups - 1, size)) + np.repeat(base, size), minlength=int(groups.sum()))
    over = np.add.reduceat(np.maximum(n - 255, 0), base).astype("<u4")
    counts = np.minimum(n, 255).astype(np.uint8)
    return [over[k].tobytes() + counts[i:i + g].tobytes() for k, (i, g) in enumerate(zip(base.tolist(), groups.tolist(), strict=True))]


def group_counts(h: np.ndarray) -> bytes:
    """Point of one set."""
    return points_of(h, np.array([0, len(h)]))[0]


def point_matrix(points) -> np.ndarray:
    """Points (as ``group_counts`` gives them) as rows; finer ones are folded to
    the coarsest (groups are hashes modulo powers of two). The last coordinate
    is the sum in front."""
    groups = min(len(p) for p in points) - 4
    out = np.zeros((len(points), groups + 1), dtype=np.int32)
    for k, p in enumerate(points):
        out[k, :groups] = np.frombuffer(p, np.uint8, offset=4).reshape(-1, groups).sum(axis=0)
        out[k, groups] = np.frombuffer(p, "<u4", count=1)[0]
    return out


def packed(point: bytes) -> bytes:
    """A point as it is stored and dealt, to as many trees as it is in: most
    counts are 0 to 3, so Huffman codes take a quarter to a third of the bytes
    (its copies lie in different partitions, where Spark's own compression can't meet them)."""
    z = zlib.compressobj(9, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
    return point[:4] + z.compress(point[4:]) + z.flush()


def unpacked(points) -> list[bytes]:
    return [p[:4] + zlib.decompress(p[4:], -15) for p in points]


class Sizes:
    """Size bands and slices for a threshold of ``num``/``den`` shared shingles."""

    def __init__(self, num: int, den: int = 100):
        self.num, self.den = num, den
        # bands as narrow as the threshold allows keep slices large, so that
        # hardly any is empty or held by a common passage alone;
        # the first begins at the smallest size at which two different sets can reach the threshold
        n = 1
        while self.spread(n, n) < 1:
            n += 1
        self.first, edges, step = n, [n], den / num
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * step)))
        self.edges = np.array(edges)
        diff = [self.spread(int(hi) - 1, int(hi) - 1) for hi in self.edges[1:]]
        self.spare = np.array([2 + math.ceil(0.06 * d) for d in diff])          # slices that may be empty
        self.slices = np.array(diff) + 1 + self.spare

    def spread(self, a: int, b: int) -> int:
        """Most shingles that only one of two linked sets of sizes a, b holds."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def linked(self, a: int, b: int, both: int) -> bool:
        return both > 0 and self.den * both >= self.num * (a + b - both)

    def need(self, a, b):
        """Least overlap of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.den + self.num))

    def bands(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the sizes ``n``, band): each size's own band, and the next one
        if a linked larger set may be there."""
        low = np.searchsorted(self.edges, n, side="right") - 1              # -1 below the first band
        high = np.searchsorted(self.edges, n * self.den // self.num, side="right") - 1
        low = np.where(low < 0, high, low)
        count = np.where(high < 0, 0, 1 + (high > low))
        which = np.repeat(np.arange(len(n)), count)
        second = np.arange(len(which)) > (np.cumsum(count) - count)[which]
        return which, np.where(second, high[which], low[which])


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int, values=W.FOLDED):
    """(hashes sorted within each document, first of each document and the end)."""
    s, e, doc = W.spans(buf, off)
    n_docs = len(off) - 1
    if len(s) == 0:
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    bounds = W.word_bounds(doc, n_docs)
    h = W.word_hashes(buf, s, e, values)
    n_words = np.diff(bounds)
    n_win = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    owner = np.repeat(np.arange(n_docs), n_win)
    at = np.arange(len(owner)) - (np.cumsum(n_win) - n_win)[owner] + bounds[owner]
    win = W.window_sums(h, at, at + np.minimum(size, n_words[owner]))
    first = np.concatenate([[0], np.cumsum(n_win)])
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        win[i:j].sort()
    new = np.ones(len(win), dtype=bool)
    new[1:] = (win[1:] != win[:-1]) | (owner[1:] != owner[:-1])
    return win[new], np.concatenate([[0], np.cumsum(new)])[first]


SCAN = "doc_id long, tkey long, n long, fp long, point binary"
SCAN_ARROW = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("point", pa.binary())])
KEYS = "tkey long, fp long, keys array<long>"
KEYS_ARROW = pa.schema([("tkey", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])


def fingerprints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of sets (of their sorted hashes); 0 if empty."""
    return np.where(first[1:] > first[:-1], W.window_sums(h, first[:-1], first[1:]).view(np.int64), 0)


def signatures(h: np.ndarray, first: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sets: per band and slice, a hash of the slice's content. (keys,
    first of each set and the end.)"""
    size = np.diff(first)
    which, band = sizes.bands(size)
    if not len(which):
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    n, spare, held = sizes.slices[band], sizes.spare[band], size[which]
    base, end = np.cumsum(n) - n, int(n.sum())
    of = np.repeat(first[which] - (np.cumsum(held) - held), held) + np.arange(int(held.sum()))
    at = mix64(h[of] ^ np.repeat((0xA5A5 + band).astype(np.uint64), held)) % np.repeat(n.astype(np.uint64), held)
    at = at.astype(np.int64) + np.repeat(base, held)
    content = np.zeros(end, dtype=np.uint64)
    np.add.at(content, at, mix64(h + np.uint64(0x51ED))[of])
    filled = np.bincount(at, minlength=end) > 0
    slot = (np.arange(end) - np.repeat(base, n)).astype(np.uint64)
    keys = mix64(mix64(content) ^ (slot * np.uint64(0x9E3779B1) + np.repeat(band.astype(np.uint64) << np.uint64(44), n)))
    # with more empty slices than the spare ones, empty slices are keys too
    kept = filled | np.repeat(n - np.add.reduceat(filled, base, dtype=np.int64) > spare, n)
    count = np.bincount(np.repeat(which, n)[kept], minlength=len(size))
    return keys[kept], np.concatenate([[0], np.cumsum(count)])


def signature(h: np.ndarray, sizes: Sizes) -> np.ndarray:
    return signatures(h, np.array([0, len(h)]), sizes)[0]


def _sets(batches: Iterator[pa.RecordBatch], text_at: int, size: int):
    """(rows, hashes of their shingle sets, first of each set and the end) per block of texts."""
    for b in batches:
        for i, j, buf, off in W.blocks(b.column(text_at), BLOCK_BYTES):
            yield b.slice(i, j - i), *shingle_sets(buf, off, size)


def _arrow(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _scan(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, h, first in _sets(batches, 2, size):
            yield _arrow(SCAN_ARROW, b.column(0), b.column(1), np.diff(first), fingerprints(h, first), [packed(p) for p in points_of(h, first)])
    return run


def _keys(size: int, sizes: Sizes, repeated, again: bool):
    """A second pass over the texts: keys are most of what a set is dealt by,
    and hashing again costs less than storing them. Only texts that may be
    ``repeated`` (their tkey), or only the others, are hashed: between them the
    two passes hash each text once. (The choice is made here, since a filter of
    its own before this function would hold a second Python worker for each task.)"""
    def chosen(batches):
        for b in batches:
            yield b.filter(pa.array(repeated.value.may_hold(b.column(0).to_numpy(zero_copy_only=False)) == again))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, h, first in _sets(chosen(batches), 1, size):
            keys, at = signatures(h, first, sizes)
            keys = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.view(np.int64)))
            yield _arrow(KEYS_ARROW, b.column(0), fingerprints(h, first), keys)
    return run


BUCKET = "bucket long, key long, chunk int, members array<long>"
BUCKET_ARROW = pa.schema([("bucket", pa.int64()), ("key", pa.int64()), ("chunk", pa.int32()), ("members", pa.list_(pa.int64()))])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cls) sorted → trees with at least two members. A key with many
    members is cut into chunks of CHUNK; its first member leads every chunk.
    ``bucket`` hashes the members, so that the many trees of one pair (or
    group) are told to be the same."""
    seen: set[int] = set()
    tail = None                       # (key, first member, chunk number, members not yet written)
    rows: list[tuple] = []

    def put(key, chunk, members):
        bucket = int(W.window_sums(members.view(np.uint64), np.array([0]), np.array([len(members)])).view(np.int64)[0])
        if chunk < 0:                 # the only chunk of its key
            if bucket in seen:
                return
            if len(seen) < 1_000_000:  # spares repeated rows; what it misses is removed later
                seen.add(bucket)
        rows.append((bucket, key, chunk, members))

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                          pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], schema=BUCKET_ARROW)
        rows.clear()
        return out

    def close():
        key, lead, chunk, members = tail
        if chunk == 0 and len(members) > 1:
            put(key, -1, members)
        elif chunk > 0 and len(members):
            put(key, chunk, np.concatenate([[lead], members]))

    for b in batches:
        key, cls = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(key):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        # runs of one row say nothing unless they touch the batch's border
        long = (np.diff(cuts) > 1) | (np.arange(len(cuts) - 1) == 0) | (np.arange(len(cuts) - 1) == len(cuts) - 2)
        for i, j in zip(cuts[:-1][long].tolist(), cuts[1:][long].tolist(), strict=True):
            k, own = int(key[i]), cls[i:j]
            if tail is not None and tail[0] == k:
                tail = (k, tail[1], tail[2], np.concatenate([tail[3], own]))
            else:
                if tail is not None:
                    close()
                tail = (k, own[0], 0, own)
            while len(tail[3]) > CHUNK:
                part = tail[3][:CHUNK]
                put(k, tail[2], part if tail[2] == 0 else np.concatenate([[tail[1]], part]))
                tail = (k, tail[1], tail[2] + 1, tail[3][CHUNK:])
        if len(rows) > 2000:
            yield flush()
    if tail is not None:
        close()
    yield flush()


class RTree:
    """Points bulk-loaded by halving on the widest coordinate; a node keeps the
    largest coordinates, the smallest size and its component if it has one."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comp: np.ndarray):
        self.points, self.sizes, self.comp = points, sizes, comp
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, at: np.ndarray) -> int:
        p, c = self.points[at], self.comp[at]
        kids = None
        if len(at) > LEAF:
            d = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            order = at[np.argsort(p[:, d], kind="stable")]
            kids = (self._build(order[:len(at) // 2]), self._build(order[len(at) // 2:]))
        self.nodes.append((p.max(axis=0), int(self.sizes[at].min()), int(c[0]) if (c == c[0]).all() else None, kids, at))
        return len(self.nodes) - 1

    def search(self, point: np.ndarray, size: int, comp: int, rule: Sizes) -> np.ndarray:
        """Members of other components whose bound reaches the threshold."""
        todo, found = [self.root], []
        while todo:
            top, least, own, kids, at = self.nodes[todo.pop()]
            if own == comp or np.minimum(point, top).sum() < rule.need(size, least):
                continue
            if kids:
                todo += kids
                continue
            n = self.sizes[at]
            ok = (np.minimum(point, self.points[at]).sum(axis=1) >= rule.need(size, n)) & (self.comp[at] != comp)
            found.append(at[ok])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


PAIR = "a long, b long"
PAIR_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=PAIR_ARROW)


def _chain(rule: Sizes):
    """First round: each member of a tree with the earlier member of the largest
    bound (and with the leader): a number of pairs linear in the members."""
    def run(batches):
        left, right = [], []
        for _, cls, n, point in sorted_runs(batches):
            if len(cls) < 2:
                continue
            p = point_matrix(unpacked(point))
            for k in range(1, len(cls)):
                bound = np.minimum(p[k], p[:k]).sum(axis=1) - rule.need(n[k], n[:k])
                for other in {int(np.argmax(bound)), 0}:
                    if bound[other] >= 0:
                        left.append(int(cls[k]))
                        right.append(int(cls[other]))
            if len(left) > 20_000:
                yield _pairs(left, right)
                left, right = [], []
        yield _pairs(left, right)
    return run


def earlier(own, others, tree: int, one: bool) -> np.ndarray:
    """Which of ``others`` (lists of the first trees of members) meet ``own`` in
    a tree that gives their pair instead of ``tree``: a smaller one, or any if
    ``tree`` is of two chunks (``one`` false; such trees are in no list)."""
    mine = np.asarray(own)
    mine = mine[mine < tree] if one else mine
    at = np.cumsum([0, *map(len, others)])
    met = np.isin(np.concatenate(others), mine)
    return np.diff(np.concatenate([[0], np.cumsum(met)])[at]) > 0


def _search(rule: Sizes):
    """Second round: all surviving pairs across components. Rows: (tree, side,
    cls, component, n, point, trees); side 0 is searched in the tree of side 1,
    or in its own tree if there is no side 1. ``trees`` are a member's smallest
    trees: a pair that two members have in an earlier common one is left to it,
    so near copies that share most trees do not give their pairs in all of them."""
    def run(batches):
        left, right = [], []
        for name, side, cls, comp, n, point, first in sorted_runs(batches):
            if (comp == comp[0]).all():
                continue
            p = point_matrix(unpacked(point))
            probe, home = np.flatnonzero(side == 0), np.flatnonzero(side == (1 if (side == 1).any() else 0))
            # a pair across components has a member outside the largest one
            names, sizes = np.unique(comp, return_counts=True)
            most = names[np.argmax(sizes)]
            one = side[0] == side[-1]
            trees = [(RTree(p[home], n[home], comp[home]), home)]
            outside = home[comp[home] != most]
            trees.append((RTree(p[outside], n[outside], comp[outside]), outside) if len(outside) and not one else None)
            for k in probe:
                if comp[k] == most and trees[1] is None:
                    continue
                tree, of = trees[int(comp[k] == most)]
                near = of[tree.search(p[k], int(n[k]), int(comp[k]), rule)]
                if len(near):
                    near = near[~earlier(first[k], first[near], int(name[0]), one)]
                for m in near:
                    if not one or comp[m] == most or cls[k] < cls[m]:
                        left.append(int(cls[k]))
                        right.append(int(cls[m]))
                if len(left) > 20_000:
                    yield _pairs(left, right)
                    left, right = [], []
        yield _pairs(left, right)
    return run


def _verify(size: int, rule: Sizes):
    def run(batches):
        for b in batches:
            a_key, b_key = (c.to_numpy(zero_copy_only=False) for c in b.columns[:2])
            new = np.ones(len(b_key), dtype=bool)           # a text b is hashed once for its consecutive pairs
            new[1:] = b_key[1:] != b_key[:-1]
            others = _one_by_one(b.column(3).filter(pa.array(new)), size)
            left, right = [], []
            for k, one in enumerate(_one_by_one(b.column(2), size)):
                if new[k]:
                    last = next(others)
                both = np.concatenate([one, last])
                both.sort()
                if rule.linked(len(one), len(last), int(np.count_nonzero(both[1:] == both[:-1]))):
                    left.append(int(a_key[k]))
                    right.append(int(b_key[k]))
            yield _pairs(left, right)
    return run


def _one_by_one(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    for _, _, buf, off in W.blocks(texts, BLOCK_BYTES):
        h, first = shingle_sets(buf, off, size)
        yield from (h[i:j] for i, j in zip(first[:-1], first[1:], strict=True))


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, num: int = 85, den: int = 100,
                          filter_blocks: int = 1 << 18) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id
    reachable by links), tkey (hash of the text).

    Documents link when ``den`` × shared shingles >= ``num`` × all shingles of
    both. Words are runs of anything but ASCII white space, A-Z lower-cased; a
    document of fewer than ``size`` words is one shingle; one without words (or
    null) has none and links with nothing. Null ids never name a component
    unless all its ids are null; repeated rows link with each other; other
    columns are ignored; an empty table gives an empty result. Results are
    exact up to collisions of 64-bit hashes.
    """
    rule = Sizes(num, den)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tkey", F.xxhash64("text"))
    scanned = stored(rows.select("doc_id", "tkey", "text").mapInArrow(_scan(size), SCAN), "shingles")
    some_words = scanned.where("n > 0")
    # rows whose set occurs once pass as they are; only the others are grouped
    again = stored(some_words.groupBy("fp").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("fp"), "repeated-sets")
    repeated = docs.sparkSession.sparkContext.broadcast(BlockedBloom.build(again, "fp", filter_blocks))

    @F.pandas_udf("boolean")
    def may_repeat(k):
        return pd.Series(repeated.value.may_hold(k.to_numpy("int64")))

    def classes(alone: DataFrame, again: DataFrame, *columns: str) -> DataFrame:
        return alone.select("fp", F.col("tkey").alias("cls"), *columns).unionByName(
            again.groupBy("fp").agg(F.min("tkey").alias("cls"), *[F.first(c).alias(c) for c in columns]))

    points = stored(classes(some_words.where(~may_repeat("fp")), some_words.where(may_repeat("fp")), "n", "point"), "points")
    # the same by text: all texts of a repeated set are told before they are hashed
    copies = docs.sparkSession.sparkContext.broadcast(BlockedBloom.build(some_words.where(may_repeat("fp")), "tkey", filter_blocks))
    keyed = [rows.select("tkey", "text").mapInArrow(_keys(size, rule, copies, again), KEYS).where(F.size("keys") > 0) for again in (False, True)]
    dealt = classes(*keyed, "keys").select(F.explode("keys").alias("key"), "cls")
    buckets = (dealt.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(_buckets, BUCKET))
    buckets = stored(buckets, "trees")
    trees = stored(buckets.dropDuplicates(["bucket"]).select("bucket", "members"), "trees")
    member = trees.select("bucket", F.explode("members").alias("cls"))

    def tested(pairs: DataFrame) -> DataFrame:
        return stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = stored(pairs.select(F.col("a").alias("tkey")).union(pairs.select("b")).distinct(), "wanted")
        held = docs.sparkSession.sparkContext.broadcast(BlockedBloom.build(wanted, "tkey", filter_blocks))

        @F.pandas_udf("boolean")
        def wants(k):
            return pd.Series(held.value.may_hold(k.to_numpy("int64")))

        texts = stored(rows.select("tkey", "text").where(wants("tkey")).join(wanted, "tkey", "left_semi").dropDuplicates(["tkey"]), "texts")
        both = (pairs.join(texts.select(F.col("tkey").alias("a"), F.col("text").alias("ta")), "a")
                .join(texts.select(F.col("tkey").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb"))
        return stored(both.mapInArrow(_verify(size, rule), PAIR), "links")

    def labelled(links: DataFrame) -> DataFrame:
        comp = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        return stored(comp.select(F.col("node").alias("cls"), F.col("component").alias("comp")), "components")

    chained = (member.join(points.drop("fp"), "cls").select("bucket", "cls", "n", "point")
               .repartition("bucket").sortWithinPartitions("bucket", "cls").mapInArrow(_chain(rule), PAIR))
    first = tested(chained)
    links = verified(first)
    comp = labelled(links)

    # second round: trees (and pairs of chunks of one key) that span components;
    # the one pair of a tree of two is settled already
    named = stored(member.join(comp, "cls", "left").select("bucket", "cls", F.coalesce("comp", "cls").alias("comp")), "tree-members")
    span = stored(named.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n")), "tree-span")
    own = named.join(span.where("low <> high AND n > 2").select("bucket"), "bucket", "left_semi").select(
        F.col("bucket").alias("tree"), F.lit(0).alias("side"), "cls", "comp")
    chunks = buckets.where("chunk >= 0").select("key", "chunk", "bucket").join(span, "bucket")
    apart = (chunks.alias("x").join(chunks.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.chunk") < F.col("y.chunk"))
                                    & ~((F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low"))))
             .select(F.col("x.bucket").alias("p"), F.col("y.bucket").alias("q")).distinct()
             .select(F.xxhash64("p", "q").alias("tree"), F.explode(F.array(F.struct("p", F.lit(0).alias("side")), F.struct(F.col("q").alias("p"), F.lit(1).alias("side")))).alias("s"))
             .select("tree", F.col("s.side").alias("side"), F.col("s.p").alias("bucket")))
    across = apart.join(named, "bucket").select("tree", "side", "cls", "comp")
    # a member's trees are at most as many as its keys
    early = own.groupBy("cls").agg(F.slice(F.sort_array(F.collect_set("tree")), 1, FIRST).alias("trees"))
    inside = (points.select("cls", "n", "point").join(early, "cls", "left")
              .select("cls", "n", "point", F.coalesce("trees", F.array().cast("array<long>")).alias("trees")))
    more = (own.unionByName(across).join(inside, "cls").select("tree", "side", "cls", "comp", "n", "point", "trees")
            .repartition("tree").sortWithinPartitions("tree", "side", "cls").mapInArrow(_search(rule), PAIR))
    second = verified(stored(tested(more).join(first, ["a", "b"], "left_anti"), "pairs"))
    if not second.isEmpty():
        comp = labelled(links.unionByName(second))

    # class → component → smallest document
    by_fp = (points.select("fp", "cls").join(comp, "cls", "left").select("fp", F.coalesce("comp", "cls").alias("comp")))
    by_fp = stored(by_fp, "class-components")
    least = scanned.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc"))
    low = stored(least.join(by_fp, "fp").groupBy("comp").agg(F.min("doc").alias("component_id")), "component-ids")
    ids = stored(by_fp.join(low, "comp").select("fp", "component_id"), "class-ids")
    some = scanned.where("n > 0").select("doc_id", "n", "fp", "tkey").join(ids, "fp").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "tkey")
    none = scanned.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "tkey")
    return some.unionByName(none)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """``docs`` with one row of each component: the one whose hash of id and
    text is smallest (of equal rows any one). Texts without words all stay;
    columns stay as they are."""
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    found = similarity_components(docs.select(row.alias("doc_id"), text_col), "doc_id", text_col, **rule).where("n_shingles > 0")
    found = stored(found.groupBy("doc_id").agg(F.first("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "rows-of-components")
    kept = drop_keys(docs, row, found.where("doc_id <> component_id").select("doc_id"))
    again = stored(found.where("doc_id = component_id AND n > 1").select("doc_id"), "repeated-rows")
    if again.isEmpty():
        return kept
    name = fresh(docs, "row_key")
    copies = docs.withColumn(name, row).join(again.select(F.col("doc_id").alias(name)), name, "left_semi").dropDuplicates([name])
    return drop_keys(kept, row, again).unionByName(copies.drop(name))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similarity_components(read(spark, sf_dir, "documents")).drop("tkey")
