"""Line dedup: explode normalised lines, hash, count distinct documents per
hash, drop lines over a threshold, reassemble by position. Built-in functions
only.

A line's key is the line without white space at both ends and with A-Z
lower-cased; it is held as two 64-bit hashes with different seeds, so texts
are not shuffled to count them. A key counts once per document (row); keys
without a code point are never counted. What is shuffled is 16 bytes a line,
reduced by a partial count first, and then the positions of the lines to
drop. Those meet their document as bit masks of ``WORD`` lines each, so a
text of any number of lines is filtered in one pass over its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import fresh, read, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
WORD = 62
MIN_DOCS = 10


def line_key(line):
    """The line stripped and with A-Z lower-cased. The built-in ``lower``
    changes letters beyond ASCII too, so it is taken for ASCII lines only."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(key):
    """Two hashes of a key, null for an empty one."""
    return F.when(key != "", F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(11), key).alias("b")))


def drop_common_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = MIN_DOCS,
                      n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with the lines of ``text_col`` dropped whose key is in at least
    ``min_docs`` rows, and with ``n_lines`` (before) and ``n_dropped`` added.

    Null and empty texts have one empty line and become empty texts. Rows stay
    as they are otherwise, repeated ones included: each counts as a document.
    Columns that already have the two names are replaced, all others kept; a
    text may have any length.
    """
    text, row = fresh(docs, "line_text"), fresh(docs, "line_row")
    base = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # equal rows get equal masks, so the hash of id and text is enough to find a row again
    base = base.withColumn(row, F.struct(F.xxhash64(id_col, text).alias("a"), F.xxhash64(F.lit(11), id_col, text).alias("b")))
    lines = F.transform(F.split(text, "\n"), lambda s: _hashes(line_key(s)))
    keyed = stored(base.select(F.col(row).alias("row"), lines.alias("keys")), "line-keys")

    common = stored(
        keyed.select(F.explode(F.array_distinct("keys")).alias("key")).where("key IS NOT NULL")
        .groupBy("key.a", "key.b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("a", "b"), "line-common")
    at = keyed.select("row", F.posexplode("keys").alias("pos", "key")).where("key IS NOT NULL").select("row", "pos", "key.a", "key.b")
    # the same text may stand in several rows: or-ing its bits again changes nothing
    bit = F.expr(f"shiftleft(1L, pos % {WORD})")
    masks = stored(
        at.join(common, ["a", "b"], "left_semi").groupBy("row", F.expr(f"pos div {WORD}").alias("word")).agg(F.bit_or(bit).alias("bits"))
        .groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words")), "line-masks")

    words, all_lines, mask = (fresh(docs, c) for c in ("line_words", "line_all", "line_mask"))
    met = base.join(masks.select(F.col("row").alias(row), F.col("words").alias(words)), row, "left")
    split = met.withColumn(all_lines, F.split(text, "\n"))
    dense = split.withColumn(mask, F.when(F.col(words).isNotNull(), F.transform(
        F.sequence(F.lit(0), F.expr(f"cast((size({all_lines}) - 1) div {WORD} as int)")),
        lambda w: F.coalesce(F.try_element_at(F.col(words), w.cast("long")), F.lit(0).cast("long")))))
    out = F.when(F.col(mask).isNull(), F.col(text)).otherwise(F.array_join(F.expr(
        f"filter({all_lines}, (s, i) -> (shiftright({mask}[cast(i div {WORD} as int)], i % {WORD}) & 1) = 0)"), "\n"))
    gone = F.coalesce(F.aggregate(mask, F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w)), F.lit(0).cast("long"))
    columns = {c: F.col(c) for c in docs.columns} | {text_col: out, n_lines: F.size(all_lines).cast("long"), n_dropped: gone}
    return dense.select(*[f.alias(c) for c, f in columns.items()])


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM t),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
