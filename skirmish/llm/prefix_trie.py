"""Conversation prefix trie by fixed-length block hashing.

Conversations are rebuilt (a shared head, then their own turns) and cut into
blocks of ``BLOCK`` turns. A prefix is named by the xor of its turns' hashes,
each mixed with the turn's place, so a prefix at a block's end is the xor of
the block digests so far. Conversations are grouped by these block ends
first: the rows of a block *class* (same prefix, same block) fold to one row.
Turn boundaries are refined only inside blocks whose prefix goes on in more
than one way; the other blocks are plain paths whose nodes all have the
class's members.

Sums over subtrees need no walk over depths. Every node is owned by its
smallest member, and what a conversation owns is the end of its path: it
follows others' nodes for its first A code points. Members that don't own a
node u go on sharing from u for A minus the code points before u, which adds
up to the code points that u's subtree saves. Leaves are counted by their
owners. So both are sums over members, made per block class and then per node.

Names are 128-bit hashes of role and text. No step puts all rows of a
conversation, of a node or of a prefix into one task, except that the ids
that end at one node are hashed in one stream (SHA-256 can't be split), from
pieces of up to ``PIECE`` ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import read, stored
from skirmish.operators.scan import carried, numbered, placed, with_carry

BLOCK = 4
FAMILY, HEADS = 100, 6
PIECE = 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "xa", "xb"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, da, db, chars): the turns in order, by turn (null first),
    then role, then the SHA-256 of the text; null role and text are empty.
    Rows without a conv_id have no conversation and are left out."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.sha2(text, 256).alias("tie"),
        F.xxhash64(role, text).alias("da"), F.xxhash64(F.lit(13), role, text).alias("db"), F.char_length(text).cast("long").alias("chars"))
    return numbered(rows, ["conv_id"], ["turn", "role", "tie"], name="trie-turns").select("conv_id", "pos", "da", "db", "chars")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """((conv_id, p, da, db, chars), (conv_id,) of all conversations): each
    conversation c gets the first h = crc32(c) % ``heads`` turns of
    c - c % ``family`` in place of its own first h."""
    opening = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < heads - 1)).groupBy(F.col("conv_id").alias("root")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "da", "db", "chars"))).alias("opening"))
    convs = turns.select("conv_id").distinct().withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int"))
    convs = stored(
        convs.withColumn("root", F.col("conv_id") - F.col("conv_id") % family).join(opening, "root", "left")
        .select("conv_id", "h", F.filter(F.coalesce("opening", F.array().cast(opening.schema["opening"].dataType)), lambda t: t["pos"] < F.col("h"))
                .alias("head")), "trie-convs")
    own = turns.join(convs.select("conv_id", "h", F.size("head").alias("n")), "conv_id").where(F.col("pos") >= F.col("h")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("p"), "da", "db", "chars")
    head = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("p"), "t.da", "t.db", "t.chars")
    return own.unionByName(head), convs.select("conv_id")


def block_rows(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation and block: its turns, and the prefix before
    (``ya, yb``) and after it (``za, zb``) with the code points before it."""
    mixed = rows.select("conv_id", "p", "chars", F.xxhash64("da", "db", "p").alias("a"), F.xxhash64(F.lit(17), "db", "da", "p").alias("b"))
    blocks = mixed.groupBy("conv_id", F.expr(f"p div {block}").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("p", "a", "b", "chars"))).alias("turns"),
        F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"), F.sum("chars").alias("chars"))
    local = placed(blocks, ["conv_id"], ["block"], "trie-blocks", {"za": F.bit_xor("xa"), "zb": F.bit_xor("xb"), "upto": F.sum("chars")})
    carry = carried(local, ["conv_id"], {"ca": F.bit_xor("xa"), "cb": F.bit_xor("xb"), "cn": F.sum("chars")},
                    {"before_a": F.bit_xor("ca"), "before_b": F.bit_xor("cb"), "before": F.sum("cn")})
    whole = with_carry(local, carry, ["conv_id"])
    zero = F.lit(0).cast("long")
    za, zb = F.col("za").bitwiseXOR(F.coalesce("before_a", zero)), F.col("zb").bitwiseXOR(F.coalesce("before_b", zero))
    return whole.select("conv_id", "block", "turns", za.bitwiseXOR(F.col("xa")).alias("ya"), zb.bitwiseXOR(F.col("xb")).alias("yb"),
                        za.alias("za"), zb.alias("zb"), (F.coalesce("before", zero) + F.col("upto") - F.col("chars")).alias("chars_before"))


CLASS = ["block", "ya", "yb", "za", "zb", "k"]


def block_classes(blocks: DataFrame) -> DataFrame:
    """One row per distinct block: members, the smallest of them, its turns,
    and whether its prefix goes on in several ways (``split``)."""
    classes = stored(blocks.withColumn("k", F.size("turns")).groupBy(*CLASS).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns"),
        F.first("chars_before").alias("chars_before")), "trie-classes")
    ways = stored(classes.groupBy("block", "ya", "yb").agg(F.count(F.lit(1)).alias("ways")), "trie-ways")
    return stored(classes.join(ways, ["block", "ya", "yb"]).withColumn("split", F.col("ways") > 1).drop("ways"), "trie-classes")


def refined(classes: DataFrame, sums: list[str], lows: list[str] = (), block: int = BLOCK) -> DataFrame:
    """The turn nodes inside the blocks: (depth, xa, xb) with parent prefix,
    last text's code points and code points up to it. Only blocks that split
    are grouped; ``sums`` and ``lows`` are class columns to add up or take the
    least of."""
    xor = lambda lane, start: f"aggregate(slice(turns, 1, {{j}}), {start}, (s, t) -> s ^ t.{lane})"
    at = lambda j: (f"{xor('a', 'ya').format(j=j)}", f"{xor('b', 'yb').format(j=j)}")
    (xa, xb), (pa_, pb) = at("j"), at("j - 1")
    inner = classes.withColumn("node", F.explode(F.expr(
        f"transform(sequence(1, k), j -> named_struct('depth', block * {block} + j, 'xa', {xa}, 'xb', {xb}, 'pa', {pa_}, 'pb', {pb}, "
        "'last', turns[j - 1].chars, 'upto', chars_before + aggregate(slice(turns, 1, j), 0L, (s, t) -> s + t.chars)))")))
    flat = inner.select("split", "node.*", *sums, *lows)
    same = ["pa", "pb", "last", "upto"]
    grouped = flat.where("split").groupBy(*NODE).agg(
        *[F.first(c).alias(c) for c in same], *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in lows])
    return grouped.unionByName(flat.where("NOT split").drop("split").select(*NODE, *same, *sums, *lows))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids sorted by node → pieces of comma-joined ids, each of one node."""
    for b in batches:
        d, a, x, c = (col.to_numpy(zero_copy_only=False) for col in b.columns)
        if len(c) == 0:
            continue
        cut = np.flatnonzero((d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (x[1:] != x[:-1])) + 1
        out = []
        for i, j in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(c)]]), strict=True):
            for k in range(i, j, PIECE):
                e = min(j, k + PIECE)
                out.append((d[k], a[k], x[k], c[k], ",".join(map(str, c[k:e].tolist())).encode()))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.binary()), strict=True)],
                                         ["depth", "xa", "xb", "least", "piece"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (node, least id) → one hash per node, in one stream."""
    schema = pa.schema([("depth", pa.int64()), ("xa", pa.int64()), ("xb", pa.int64()), ("ends_sha256", pa.string())])
    node, h = None, None
    for b in batches:
        done = []
        for d, a, x, piece in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if (d, a, x) != node:
                if node is not None:
                    done.append((*node, h.hexdigest()))
                node, h = (d, a, x), hashlib.sha256()
            else:
                h.update(b",")
            h.update(piece)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, h.hexdigest()), schema, strict=True)], schema=schema)


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, xa, xb, conv_id) → SHA-256 of each node's ids, ascending and
    comma-joined."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*NODE, "conv_id"]
    pieces = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        _joined_ids, "depth long, xa long, xb long, least long, piece binary")
    return pieces.repartition(n, *NODE).sortWithinPartitions(*NODE, "least").mapInArrow(
        _hashed, "depth long, xa long, xb long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, block: int = BLOCK) -> DataFrame:
    """The trie of the rebuilt conversations, one row per node: conv_id (least
    member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (code points) and ends_sha256.

    Nulls, ties and repeated rows: see ``turns_of``; every row is a turn. A
    conversation without turns is a member of the root only. Without
    conversations there is no node. Other columns are not read.
    """
    turns = turns_of(conversations)
    rows, convs = rebuilt(turns, family, heads)
    blocks = stored(block_rows(rows, block), "trie-blocks")
    classes = block_classes(blocks)
    zero = F.lit(0).cast("long")

    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        *[zero.alias(c) for c in (*NODE, "pa", "pb", "last", "upto")], "n_convs", "conv_id")
    nodes = stored(root.unionByName(refined(classes, ["n_convs"], ["conv_id"], block)), "trie-nodes")

    # each node with its parent's owner and its children
    up = [F.col("depth").alias("_depth"), F.col("xa").alias("pa"), F.col("xb").alias("pb")]
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *up[1:], F.col("conv_id").alias("parent_conv_id"))
    children = stored(nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("xa"), F.col("pb").alias("xb"))
                      .agg(F.count(F.lit(1)).alias("n_children")), "trie-children")
    linked = stored(nodes.join(parents, ["depth", "pa", "pb"], "left").join(children, NODE, "left")
                    .withColumn("n_children", F.coalesce("n_children", zero)), "trie-linked")

    # per conversation: where it ends, the code points it shares, whether it owns a leaf
    last = blocks.groupBy("conv_id").agg(F.max_by(F.struct((F.col("block") * block + F.size("turns")).alias("depth"), F.col("za").alias("xa"),
                                                          F.col("zb").alias("xb"), (F.col("chars_before") + F.aggregate(
                                                              "turns", zero, lambda s, t: s + t["chars"])).alias("total")), "block").alias("e"))
    first_owned = linked.where("parent_conv_id IS NULL OR parent_conv_id <> conv_id").select("conv_id", (F.col("upto") - F.col("last")).alias("shared"))
    leaf = linked.where("n_children = 0").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    per_conv = stored(
        convs.join(last, "conv_id", "left").join(first_owned, "conv_id", "left").join(leaf, "conv_id", "left").select(
            "conv_id", *[F.coalesce(F.col(f"e.{c}"), zero).alias(c) for c in NODE],
            F.coalesce("shared", "e.total", zero).alias("shared"), F.coalesce("leaf", zero).alias("n_leaves")), "trie-convs")

    attrs = per_conv.select("conv_id", "shared", "n_leaves")
    weights = stored(blocks.withColumn("k", F.size("turns")).select("conv_id", *CLASS).join(attrs, "conv_id").groupBy(*CLASS)
                     .agg(F.sum("shared").alias("shared"), F.sum("n_leaves").alias("n_leaves")), "trie-weights")
    sums = refined(classes.join(weights, CLASS), ["shared", "n_leaves"], block=block).select(*NODE, "shared", "n_leaves")
    root_sums = attrs.agg(F.sum("shared").alias("shared"), F.sum("n_leaves").alias("n_leaves")).where("shared IS NOT NULL").select(
        *[zero.alias(c) for c in NODE], "shared", "n_leaves")
    owner = attrs.select("conv_id", F.col("shared").alias("own"))
    ends = end_hashes(per_conv.select(*NODE, "conv_id"))
    saved = F.col("shared") - F.col("own") - (F.col("n_convs") - 1) * (F.col("upto") - F.col("last"))
    return (linked.join(sums.unionByName(root_sums), NODE).join(owner, "conv_id").join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


def _crc32_sql(text: str) -> str:
    """crc32 of an ASCII text: the reflected polynomial, bit by bit."""
    bits = "list_reduce(list_concat([xor(c, b)], [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"[CAST(ascii(d) AS BIGINT) FOR d IN string_split({text}, '')]"
    return f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda c, b: {bits}))"


ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT conv_id, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % {HEADS} AS h, conv_id - conv_id % {FAMILY} AS base
       FROM (SELECT DISTINCT conv_id FROM t)),
re AS (SELECT cs.conv_id, 0 AS own, pos, role, text FROM cs JOIN t ON t.conv_id = cs.base AND t.pos < cs.h
       UNION ALL SELECT cs.conv_id, 1, pos, role, text FROM cs JOIN t USING (conv_id) WHERE t.pos >= cs.h),
st AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars,
         md5(string_agg(md5(role) || md5(text), '' ORDER BY own, pos) OVER (w ROWS UNBOUNDED PRECEDING)) AS k
       FROM re WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)),
lens AS (SELECT conv_id, coalesce(max(depth), 0) AS n FROM cs LEFT JOIN st USING (conv_id) GROUP BY conv_id),
steps AS (SELECT conv_id, depth, chars, k, lag(k, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS pk FROM st
          UNION ALL SELECT conv_id, 0, 0, '', NULL FROM cs),
nodes AS (SELECT depth, k, any_value(pk) AS pk, any_value(chars) AS chars, count(*) AS n_convs, min(conv_id) AS conv_id,
            string_agg(CASE WHEN n = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ids
          FROM steps JOIN lens USING (conv_id) GROUP BY depth, k),
kids AS (SELECT depth - 1 AS depth, pk AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, k)),
sub AS (SELECT a.depth, a.k, sum((v.n_convs - 1) * v.chars) AS saved, count(*) FILTER (WHERE v.n_children = 0) AS leaves
        FROM full_nodes v JOIN steps a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY ALL)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children,
  CAST(sub.leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ids, '')) AS ends_sha256
FROM full_nodes f JOIN sub USING (depth, k) LEFT JOIN nodes p ON p.depth = f.depth - 1 AND p.k = f.pk"""
