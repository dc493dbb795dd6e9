"""Embedding near-dedup by PCA-ordered tiled comparison.

Unit vectors are rotated so that coordinates come in the order of their
variance. The leading ones give the tiles: linked vectors differ by at most
sqrt(2 - 2t) in every coordinate, so a vector meets only tiles near its own.
Inside a pair of tiles the product of the leading dimensions is accumulated
first; the rest of it is at most the product of the suffix norms, and pairs
that cannot reach the threshold any more are given up. Survivors are compared
on the given vectors in double precision.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import connected_components, read, stored

LEADING = 3          # rotated coordinates that give the tiles
HOME, PROBE = 256, 1024
STEPS = (8, 16, 32)  # dimensions after which hopeless pairs are given up


def _second_moments(batches):
    """Partial sums of x xᵀ of unit vectors, per dimension, as (dim, place, value)."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for v in b.column(0):
            x = v.values.to_numpy().astype(np.float64)
            held = sums.setdefault(len(x), [np.zeros((len(x), len(x))), []])
            held[1].append(x / np.linalg.norm(x))
            if len(held[1]) >= 256:
                m = np.array(held[1])
                held[0] += m.T @ m
                held[1] = []
    for dim, (total, rest) in sums.items():
        if rest:
            m = np.array(rest)
            total = total + m.T @ m
        yield pa.RecordBatch.from_pydict({"dim": np.full(dim * dim, dim, np.int32), "place": np.arange(dim * dim, dtype=np.int32), "value": total.ravel()})


def rotations(classes: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension the eigenvectors of the second moments, by falling
    eigenvalue. The sums are added up in Spark; dim² numbers reach the driver."""
    rows = classes.select("embedding").mapInArrow(_second_moments, "dim int, place int, value double").groupBy("dim", "place").agg(F.sum("value").alias("value"))
    out: dict[int, np.ndarray] = {}
    for dim, part in rows.toPandas().groupby("dim"):
        m = np.zeros(dim * dim)
        m[part["place"].to_numpy()] = part["value"].to_numpy()
        m = m.reshape(dim, dim)
        out[int(dim)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]
    return out


NEAR = [d for d in itertools.product((-1, 0, 1), repeat=LEADING) if d >= (0,) * LEADING]
CELL = "cid long, label long, embedding array<double>, copies long, cell long, near array<long>"
CELL_ARROW = pa.schema([("cid", pa.int64()), ("label", pa.int64()), ("embedding", pa.list_(pa.float64())), ("copies", pa.int64()),
                        ("cell", pa.int64()), ("near", pa.list_(pa.int64()))])


def _cell_id(label: int, dim: int, c) -> int:
    out = (label * 1_000_003 + dim) & 0xFFFFFFFF
    for k in c:
        out = (out * 2053 + int(k) + 1024) & 0x7FFFFFFFFFFFFFFF
    return out


def _cells(turn: dict[int, np.ndarray], width: float):
    """Own tile of each vector, and the tiles at or after it in half the
    directions that hold points within ``width`` (so each pair meets once)."""
    def run(batches):
        for b in batches:
            label, vectors = b.column(1).to_pylist(), b.column(2)
            cell, near = [], []
            for k, v in enumerate(vectors):
                x = v.values.to_numpy()
                y = np.zeros(LEADING)
                lead = min(LEADING, len(x))
                y[:lead] = (x / np.linalg.norm(x)) @ turn[len(x)][:, :lead]
                c = np.floor(y / width)
                below, above = y - c * width, (c + 1) * width - y
                own = []
                for d in NEAR:
                    gap = sum((below[i] if s < 0 else above[i]) ** 2 for i, s in enumerate(d) if s)
                    if gap <= width * width * (1 + 1e-9):
                        own.append(_cell_id(label[k], len(x), c + np.array(d)))
                cell.append(_cell_id(label[k], len(x), c))
                near.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(pa.list_(pa.float64())), b.column(3), pa.array(cell, pa.int64()),
                                              pa.array(near, pa.list_(pa.int64()))], schema=CELL_ARROW)
    return run


def linked_pairs(a: np.ndarray, b: np.ndarray, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of a and b with cosine >= threshold (double)."""
    ua, ub = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
    ra, rb = ua @ turn, ub @ turn
    ta, tb = (np.sqrt(np.maximum(0, np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1])) for r in (ra, rb))   # suffix norms
    dim, done, slack = a.shape[1], 0, 1e-9
    part, i, j = None, None, None
    for step in [s for s in STEPS if s < dim]:
        if part is None:
            dot = ra[:, :step] @ rb[:, :step].T
            i, j = np.nonzero(dot + np.outer(ta[:, step], tb[:, step]) >= threshold - slack)
            part = dot[i, j]
        else:
            part = part + np.einsum("ij,ij->i", ra[i, done:step], rb[j, done:step])
            ok = part + ta[i, step] * tb[j, step] >= threshold - slack
            i, j, part = i[ok], j[ok], part[ok]
        done = step
    if part is None:
        i, j = np.nonzero(ra @ rb.T >= threshold - slack)
    cos = np.einsum("ij,ij->i", a[i], b[j]) / (np.linalg.norm(a, axis=1)[i] * np.linalg.norm(b, axis=1)[j])
    ok = cos >= threshold
    return i[ok], j[ok]


LINK = "cid long, links long, root long"
LINK_ARROW = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _compare(turn: dict[int, np.ndarray], threshold: float):
    """Rows sorted by (tile, side): home vectors, then probes. Per vector with
    links in this tile: the number of linked vectors and a root that joins it
    to the others of its group here."""
    def run(batches):
        for b in _tiles(batches):
            side, cid, copies, same, vectors = b
            home, probe = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(home) or not len(probe):
                continue
            a, p = np.array([vectors[k] for k in home]), np.array([vectors[k] for k in probe])
            i, j = linked_pairs(a, p, turn[a.shape[1]], threshold)
            ok = ~same[probe[j]] | (cid[probe[j]] < cid[home[i]])        # pairs of one tile are met from both sides
            i, j = home[i[ok]], probe[j[ok]]
            if not len(i):
                continue
            n = np.bincount(i, weights=copies[j], minlength=len(side)) + np.bincount(j, weights=copies[i], minlength=len(side))
            root = cid.copy()
            while True:
                low = np.minimum(root[i], root[j])
                before = root.copy()
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
                if (root == before).all():
                    break
            hit = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(cid[hit]), pa.array(n[hit].astype(np.int64)), pa.array(root[hit])], schema=LINK_ARROW)
    return run


def _tiles(batches):
    """One group of column arrays per tile; a tile has about HOME + PROBE rows."""
    held = None
    for b in batches:
        tile, side, cid, copies, same = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        vectors = [v.values.to_numpy() for v in b.column(5)]
        if held is not None:
            tile, side, cid, copies, same = (np.concatenate(x) for x in zip(held[:5], (tile, side, cid, copies, same), strict=True))
            vectors = held[5] + vectors
        if not len(tile):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(tile[1:] != tile[:-1]) + 1])
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield side[i:j], cid[i:j], copies[i:j], same[i:j].astype(bool), vectors[i:j]
        z = cuts[-1]
        held = (tile[z:], side[z:], cid[z:], copies[z:], same[z:], vectors[z:])
    if held is not None and len(held[0]):
        yield held[1], held[2], held[3], held[4].astype(bool), held[5]


def half_size(vector: Column) -> Column:
    """A power of two near the square root of the vector's largest component. The
    vector divided by it twice has an exact change of scale (2^1074 is no
    double), and no norm or product of it overflows or vanishes."""
    size = F.array_max(F.transform(vector, F.abs))
    return F.pow(F.lit(2.0), F.floor(F.log2(size) / 2))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of one label and one dimension link at a cosine of ``threshold`` or
    more. Null labels, null, empty or zero vectors and those with null or
    non-finite components link with nothing and keep themselves. Finite vectors
    of any size are compared, the largest and the smallest doubles too. Equal vectors
    of a label are compared once and counted as often as they occur (repeated
    rows too). A null id never names a component unless all its ids are null,
    and is not kept. Other columns are ignored; an empty table gives an empty
    result. A hot tile is dealt to chunks on both sides, so no task holds more
    than about HOME + PROBE vectors.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = base.select("vec_id", "label", "embedding", F.when(valid, F.xxhash64("label", "embedding")).alias("cid"))
    ids = stored(rows.select("vec_id", "cid"), "vectors")
    classes = stored(rows.where("cid IS NOT NULL").groupBy("cid", "label", "embedding")
                     .agg(F.count(F.lit(1)).alias("copies"), F.first(half_size(F.col("embedding"))).alias("half"))
                     .select("cid", "label", F.transform("embedding", lambda x: x / F.col("half") / F.col("half")).alias("embedding"), "copies"), "classes")
    turn = rotations(classes)
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-6) + 1e-9
    cells = stored(classes.mapInArrow(_cells(turn, width), CELL), "cells")
    own = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    coming = cells.select(F.explode("near").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("p"))
    sizes = stored(own.join(coming, "cell").select(
        "cell", F.ceil(F.col("n") / HOME).cast("int").alias("h"), F.ceil(F.col("p") / PROBE).cast("int").alias("m")), "tiles")
    home_no, probe_no = F.pmod(F.xxhash64("cid"), F.col("h")).cast("int"), F.pmod(F.xxhash64("cid", F.lit(1)), F.col("m")).cast("int")
    columns = ["side", "cid", "copies", "same", "embedding"]
    home = cells.join(sizes, "cell").select("cell", home_no.alias("a"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("s"),
                                            F.lit(0).alias("side"), "cid", "copies", F.lit(True).alias("same"), "embedding")
    probe = (cells.select(F.col("cell").alias("from"), F.explode("near").alias("cell"), "cid", "copies", "embedding").join(sizes, "cell")
             .select("cell", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("a"), probe_no.alias("s"), F.lit(1).alias("side"),
                     "cid", "copies", (F.col("from") == F.col("cell")).alias("same"), "embedding"))
    dealt = home.unionByName(probe).select(F.xxhash64("cell", "a", "s").alias("tile"), *columns)
    links = stored(dealt.repartition("tile").sortWithinPartitions("tile", "side").mapInArrow(_compare(turn, threshold), LINK), "links")
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = connected_components(links.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    named = stored(classes.select("cid", "copies").join(counts, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
                   .select("cid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component")), "named")
    low = ids.where("cid IS NOT NULL").groupBy("cid").agg(F.min("vec_id").alias("low")).join(named, "cid").groupBy("component").agg(F.min("low").alias("component_id"))
    named = stored(named.join(low, "component").select("cid", "n_links", "component_id"), "named")
    some = ids.where("cid IS NOT NULL").join(named, "cid").select("vec_id", "n_links", "component_id")
    none = ids.where("cid IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(comp.low, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(comp.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN comp ON comp.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
