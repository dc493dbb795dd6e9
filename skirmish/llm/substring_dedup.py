"""Substring dedup by compaction of a de Bruijn graph of token k-mers.

Every window of ``k`` words is an edge from its first k-1 words to its last
k-1. The windows of one anchor lie in one bin (see ``repeats``), where runs of
consecutive edges are compacted to path pieces; equal pieces, met through
Spark joins, are repeated paths as a whole. Pieces that share their context
with another piece but are not equal (a path branches there) are opened to
single edges. Those that occur twice are joined to nonbranching paths (an edge
goes on to the only edge that follows it, if that one follows no other) by
doubling: each round of joins takes an edge twice as far back, until all know
the head of their path. Every occurrence of a path is then a span at its
source coordinates, and its words there must equal those of another one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.llm import repeats as R
from skirmish.llm import words as W
from skirmish.llm.common import read, stored


def next_links(occurrences: DataFrame) -> DataFrame:
    """``occurrences`` (tkey, at, window) of repeated edges → (edge, anc): pairs
    that always follow each other: all occurrences of ``anc`` are followed by
    ``edge`` and all of ``edge`` follow ``anc``. A text ends, so its last edge
    has no successor and the pairs never close a cycle."""
    by_text = Window.partitionBy("tkey").orderBy("at")
    step = occurrences.select(
        "window", F.when(F.lead("at").over(by_text) == F.col("at") + 1, F.lead("window").over(by_text)).alias("after"),
        F.when(F.lag("at").over(by_text) == F.col("at") - 1, F.lag("window").over(by_text)).alias("before"))
    ends = stored(step.groupBy("window").agg(
        F.count(F.lit(1)).alias("m"), *[f(c).alias(f"{name}_{c}") for c in ("after", "before")
                                        for name, f in (("n", F.count), ("low", F.min), ("high", F.max))]), "edge-ends")
    out = ends.where("n_after = m AND low_after = high_after").select(F.col("window").alias("anc"), F.col("low_after").alias("edge"))
    into = ends.where("n_before = m AND low_before = high_before").select(F.col("window").alias("edge"), F.col("low_before").alias("anc"))
    return out.join(into, ["edge", "anc"]).select("edge", "anc")


def compacted(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (edge, anc: its only predecessor; no cycles) → (edge, anc: the
    head of its path, rank: its distance from there, done). Only edges that
    have not reached their head are joined in a round, each with another
    predecessor, so a long path is no hot key."""
    every = stored(links.select("edge", "anc", F.lit(1).cast("long").alias("rank"), F.lit(False).alias("done")), "paths")
    for _ in range(max_rounds):
        if every.where("NOT done").isEmpty():
            return every
        up = every.select(F.col("edge").alias("anc"), F.col("anc").alias("head"), F.col("rank").alias("more"), F.col("done").alias("ended"))
        moved = every.where("NOT done").join(up, "anc", "left").select(
            "edge", F.coalesce("head", "anc").alias("anc"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank"),
            F.coalesce("ended", F.lit(True)).alias("done"))
        every = stored(every.where("done").unionByName(moved), "paths")
    raise RuntimeError("paths did not settle")


CHECKED = "tkey long, start int, size int, path long, low long, words binary"
CHECKED_ARROW = pa.schema([("tkey", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("path", pa.int64()), ("low", pa.int64()), ("words", pa.binary())])


def _source_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tkey, text, spans) → a row per span with the SHA-256 of its words."""
    for b in batches:
        for key, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            raw = text.as_py().encode()
            (_, _, buf, off), = W.blocks(pa.array([raw], pa.binary()), len(raw) + 1)
            s, e, _ = W.spans(buf, off)
            v = spans.values
            start, size = v.field("start").to_numpy(), v.field("size").to_numpy()
            words = [hashlib.sha256(b" ".join(raw[a:z].split())).digest() for a, z in zip(s[start].tolist(), e[start + size - 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(words), pa.int64()), v.field("start"), v.field("size"), v.field("path"), v.field("low"),
                                              pa.array(words, pa.binary())], schema=CHECKED_ARROW)


def path_spans(texts: DataFrame, occurrences: DataFrame, k: int) -> DataFrame:
    """(tkey, start, size) of the occurrences of all repeated paths, each
    verified by its words. ``occurrences`` (tkey, at, window, n) are of repeated
    edges; an edge with n > 1 stands for copies that are spans already."""
    paths = compacted(next_links(occurrences))
    rank = F.coalesce("rank", F.lit(0))
    spans = (occurrences.join(paths.select(F.col("edge").alias("window"), "anc", "rank"), "window", "left")
             .groupBy("tkey", F.coalesce("anc", "window").alias("path"), (F.col("at") - rank).alias("start"))
             .agg((F.max("at") - F.min("at") + k).cast("int").alias("size"), F.min("n").alias("low"))
             .groupBy("tkey").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), "size", "path", "low")).alias("spans")))
    checked = stored(texts.select("tkey", "text").join(spans, "tkey").mapInArrow(_source_words, CHECKED), "path-spans")
    # there is none but for collisions of hashes, so this join moves nothing
    unmet = stored(checked.groupBy("path", "words").agg(F.count(F.lit(1)).alias("m"), F.min("low").alias("low")).where("m = 1 AND low = 1")
                   .select("path", "words"), "unmet-paths")
    return checked.where("low = 1").join(unmet, ["path", "words"], "left_anti").select("tkey", "start", "size")


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 35, seed: int = 8) -> DataFrame:
    """One row per document: doc_id, n (words), n_removed, n_spans, kept_sha256.

    A word is removed if a window of ``k`` words over it also starts anywhere
    else, in the same document too; judged on the input. Words are runs of
    anything but ASCII white space. Null and empty texts have no words; texts
    shorter than ``k`` words lose none; repeated rows are copies of each other;
    null ids keep their rows; other columns are ignored; an empty table gives
    an empty result. Exact up to collisions of 64-bit hashes.
    """
    sym = R.Symbols(words=True, length=k, seed=seed)
    rows = R.text_rows(docs, id_col, text_col)
    found = R.Found(rows, sym)
    texts = R.per_text(rows, found.open)
    near = R.narrowed(texts, sym)
    texts = R.per_text(rows, found.open.join(near, "piece", "left_semi"))
    edges = stored(texts.mapInArrow(R.window_rows(sym), R.WINDOWS), "edges")
    repeated = stored(edges.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window"), "repeated-edges")
    occurrences = stored(edges.join(repeated, "window", "left_semi").select("tkey", "at", "window", "n"), "repeated-occurrences")
    return R.removed(rows, found, path_spans(texts, occurrences, k))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_words(read(spark, sf_dir, "documents")).select(
        "doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
starts AS (SELECT doc_id, list(i) AS s FROM win JOIN rep USING (h) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w WHERE len(ws) > 0),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM win JOIN rep USING (h)),
cut AS (SELECT word.doc_id, count(gone.p) AS n_removed, coalesce(string_agg(CASE WHEN gone.p IS NULL THEN word END, ' ' ORDER BY word.p), '') AS kept
        FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN cut ON w.doc_id = cut.doc_id
"""
