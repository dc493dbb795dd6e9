"""Conversation structure repair by rank-convergence parallel Viterbi.

The cheapest edits that turn a conversation's rows into the role pattern
``(s?(ua)+)?`` are a shortest path over four states (start, after s, after u,
after a). Costs are computed backwards: entry q of a row's vector is the least
cost from state q before that row to the end. Conversations are cut into
chunks of ``CHUNK`` rows. All chunks but a conversation's last start from a
speculative vector behind them; fix-up passes give each chunk the vector that
its successor now has in front and run it again, in step with its old vector,
until the two differ by a constant only: from there on the old run holds.
Passes go on until no chunk's vector changes. The constants, added up, are the
total cost. For the edits, the chunks' functions "state in, state out" are
composed in order, and every chunk is traced from its true state, taking the
ASCII-least edit that stays on a cheapest path.

A vector less its minimum takes few values, so a step is looked up by (vector,
row code) and computed once per worker.

Rows are numbered by ``operators.scan``, chunks hold at most ``CHUNK`` rows,
and composing reads a few bytes a chunk. The one thing a long conversation
does in one stream is its SHA-256, which can't be split: its rows arrive
sorted and are hashed as they pass, in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import read, stored
from skirmish.operators.scan import numbered

CHUNK = 256
BLANKS = " \t\n\x0b\x0c\r"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

# A row's code: its role's initial (s, u, a, other: x), upper case if it has
# to be deleted (blank, duplicate), with its place in this string shifted by
# four if it is truncated.
CODES = "suaxSUAXvwyz"
START, AFTER_S, AFTER_U, AFTER_A = range(4)
END = (0, 10, 5, 0)             # cost to finish after the last row
SPECULATIVE = (0, 0, 0, 0)
STEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
FILL = ("u", "u", "a", "u")     # the role an insert or a rerole has to give
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
ROLES = {"u": "user", "a": "assistant"}


def _edits(code: str, q: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the ways to take a row, in ASCII order."""
    k = CODES.index(code)
    out = [("D", DELETE, q)]
    if k < 4 or k >= 8:
        extra = TRUNCATED if k >= 8 else 0
        if (q, initial := "suax"[k % 4]) in STEP:
            out.append(("K", extra, STEP[q, initial]))
        out.append(("R", REROLE + extra, STEP[q, FILL[q]]))
    return out


@cache
def step(after: tuple, code: str) -> tuple[tuple, int]:
    """(vector before the row less its minimum, that minimum)."""
    v = [min(cost + after[to] for _, cost, to in _edits(code, q)) for q in range(4)]
    u, a = v[AFTER_U], v[AFTER_A]
    v[AFTER_U], v[AFTER_A] = min(u, a + INSERT), min(a, u + INSERT)
    for q in (START, AFTER_S):
        v[q] = min(v[q], v[AFTER_U] + INSERT)
    low = min(v)
    return tuple(x - low for x in v), low


@cache
def choose(after: tuple, code: str, q: int) -> tuple[str, int]:
    """(letters, next state) of the ASCII-least cheapest way past a row:
    inserts, then the row's own edit."""
    before, low = step(after, code)
    letters = ""
    while True:
        best = before[q] + low
        ways = [(x, to) for x, cost, to in _edits(code, q) if cost + after[to] == best]
        to = STEP[q, FILL[q]]
        if ways and ways[0][0] < "I":
            return letters + ways[0][0], ways[0][1]
        if before[to] + low + INSERT == best:
            letters, q = letters + "I", to
            continue
        return letters + ways[0][0], ways[0][1]


def vectors(codes: str, after: tuple) -> tuple[list[tuple], int]:
    """Vectors behind each row of a chunk, with the one in front of it first;
    all less their minima, whose sum is the second value."""
    out, total = [after], 0
    for code in reversed(codes):
        after, low = step(after, code)
        out.append(after)
        total += low
    return out[::-1], total


def fixed_up(codes: str, old: tuple, new: tuple, front: tuple, total: int) -> tuple[tuple, int, int]:
    """(vector in front, sum of minima, rows run) of a chunk whose vector
    behind it was ``old`` (giving ``front`` and ``total``) and is now ``new``."""
    change = 0
    for i, code in enumerate(reversed(codes)):
        if old == new:
            return front, total + change, i
        (old, a), (new, b) = step(old, code), step(new, code)
        change += b - a
    return new, total + change, len(codes)


def trace(codes: str, after: tuple, q: int) -> tuple[list[str], int]:
    """(letters of each row, state behind the chunk)."""
    behind, _ = vectors(codes, after)
    out = []
    for i, code in enumerate(codes):
        letters, q = choose(behind[i + 1], code, q)
        out.append(letters)
    return out, q


def closing(q: int) -> str:
    return "I" * (END[q] // INSERT)


# ------------------------------------------------------------------ on chunks
def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for codes, last in zip(b["codes"].to_pylist(), b["last"].to_pylist(), strict=True):
            behind = END if last else SPECULATIVE
            all_, total = vectors(codes, behind)
            rows.append((list(behind), list(all_[0]), total))
        yield pa.RecordBatch.from_arrays([*(b[c] for c in ("conv", "chunk", "codes", "last")), *_columns(rows)],
                                         ["conv", "chunk", "codes", "last", "behind", "front", "total"])


def _columns(rows: list[tuple]) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return [pa.array(cols[0], pa.list_(pa.int32())), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.int64())]


def _fix_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for codes, old, new, front, total in zip(*(b[c].to_pylist() for c in ("codes", "behind", "next", "front", "total")), strict=True):
            new = new or old
            f, t, _ = fixed_up(codes, tuple(old), tuple(new), tuple(front), total)
            rows.append((new, list(f), t))
        yield pa.RecordBatch.from_arrays([*(b[c] for c in ("conv", "chunk", "codes", "last")), *_columns(rows)],
                                         ["conv", "chunk", "codes", "last", "behind", "front", "total"])


CHUNK_SCHEMA = "conv string, chunk long, codes string, last boolean, behind array<int>, front array<int>, total long"


def converged(chunks: DataFrame) -> DataFrame:
    """Chunks (conv, chunk, codes) with their true vectors and minima. A pass
    settles at least one more chunk from the end of each conversation, so
    there are no more passes than chunks; in practice the vectors forget what
    was behind them within some rows, and one or two passes do."""
    last = chunks.groupBy("conv").agg(F.max("chunk").alias("chunk")).withColumn("last", F.lit(True))
    state = stored(chunks.join(last, ["conv", "chunk"], "left").select("conv", "chunk", "codes", F.coalesce("last", F.lit(False)).alias("last"))
                   .mapInArrow(_first_pass, CHUNK_SCHEMA), "repair-chunks")
    # conversations of one chunk are settled; the others pass vectors on
    done = state.where("last AND chunk = 0")
    state = state.where("NOT (last AND chunk = 0)")
    while True:
        ahead = state.where("chunk > 0").select("conv", (F.col("chunk") - 1).alias("chunk"), F.col("front").alias("next"))
        met = state.join(ahead, ["conv", "chunk"], "left")
        if met.where("next <> behind").isEmpty():
            return done.unionByName(state)
        state = stored(met.select("conv", "chunk", "codes", "last", "behind", "front", "total", "next").mapInArrow(_fix_up, CHUNK_SCHEMA), "repair-chunks")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk the state behind it for each state in front of it."""
    for b in batches:
        ends = [[trace(c, tuple(v), q)[1] for q in range(4)] for c, v in zip(b["codes"].to_pylist(), b["behind"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b["conv"], b["chunk"], pa.array(ends, pa.list_(pa.int32()))], ["conv", "chunk", "ends"])


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (conv, chunk) → the state in front of each."""
    conv, q = None, START
    for b in batches:
        out = []
        for c, ends in zip(b["conv"].to_pylist(), b["ends"].to_pylist(), strict=True):
            if c != conv:
                conv, q = c, START
            out.append(q)
            q = ends[q]
        yield pa.RecordBatch.from_arrays([b["conv"], b["chunk"], pa.array(out, pa.int32())], ["conv", "chunk", "state"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk its edits, the letters of each row comma-joined (the closing
    inserts belong to the last row)."""
    for b in batches:
        out = []
        for codes, behind, q, last in zip(*(b[c].to_pylist() for c in ("codes", "behind", "state", "last")), strict=True):
            letters, end = trace(codes, tuple(behind), q)
            out.append(",".join(letters) + (closing(end) if last else ""))
        yield pa.RecordBatch.from_arrays([b["conv"], b["chunk"], b["state"], pa.array(out, pa.string())], ["conv", "chunk", "state", "edits"])


def traced(settled: DataFrame) -> DataFrame:
    """(conv, chunk, state, edits) of settled chunks."""
    n = int(settled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    several = settled.where("NOT (last AND chunk = 0)")
    states = (several.mapInArrow(_ends, "conv string, chunk long, ends array<int>").repartition(n, "conv").sortWithinPartitions("conv", "chunk")
              .mapInArrow(_composed, "conv string, chunk long, state int"))
    one = settled.where("last AND chunk = 0").withColumn("state", F.lit(START))
    cols = ["conv", "chunk", "codes", "last", "behind", "state"]
    return (several.join(states, ["conv", "chunk"]).select(*cols).unionByName(one.select(*cols))
            .mapInArrow(_traced, "conv string, chunk long, state int, edits string"))


def _repaired_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv, chunk, pos), each chunk's edits before its rows →
    one hash per conversation of the lines that stay."""
    conv, h, first, q, edits = None, None, True, START, iter(())

    def put(line: str) -> None:
        nonlocal first
        h.update((line if first else "\n" + line).encode())
        first = False

    for b in batches:
        done = []
        for c, pos, role, text, state, letters in zip(*(b[x].to_pylist() for x in ("conv", "pos", "role", "text", "state", "edits")), strict=True):
            if c != conv:
                if conv is not None:
                    done.append((conv, h.hexdigest()))
                conv, h, first = c, hashlib.sha256(), True
            if pos < 0:
                q, edits = state, iter(letters.split(","))
                continue
            for x in next(edits):
                if x == "D":
                    continue
                given = FILL[q]
                if x == "K":
                    put(f"{role}:{text}")
                    given = role[0]
                else:
                    put(f"{ROLES[given]}:{text if x == 'R' else ''}")
                q = STEP[q, given]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in zip(*done, strict=True)], ["conv", "repaired_sha256"])
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([h.hexdigest()])], ["conv", "repaired_sha256"])


# ------------------------------------------------------------------ queries
def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the damage that crc32(``conv_id:turn``) % 20 deals them:
    0 dropped, 1 text emptied, 2 without its ``.!?``, 3 there twice, 4 role
    user. Null ids, turns, roles and texts are one space (a null turn stays
    null beside that)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    x = conversations.select(space("conv_id").alias("conv"), F.col("turn").alias("turn"), space("role").alias("role"),
                             space("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    twice = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return x.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(twice).alias("copy")).drop("copy")


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``rows`` (conv string, turn, role, text; no nulls but in turn) → one row
    per conv: gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256.

    Rows are taken by turn (null first), then role, then the SHA-256 of the
    text; rows equal in all of these are copies, all but the first of them
    duplicates. A role's initial is its first character; an empty role has
    none and can only be reroled or deleted.
    """
    # the order's hash also names the text when duplicates are looked for
    keyed = rows.withColumn("tie", F.sha2("text", 256))
    bare = F.btrim("text", F.lit(BLANKS))
    at = numbered(keyed, ["conv"], ["turn", "role", "tie"], name="repair-rows")
    first = at.groupBy("conv", "role", "tie").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    dead = (bare == "") | F.col("first").isNull()
    cut = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    fault = F.when(bare == "", "b").when(F.col("first").isNull(), "d").when(cut, "t").otherwise("")
    cases = [F.when(dead, up).when(cut, late).otherwise(low) for low, up, late in zip(CODES[:4], CODES[4:8], CODES[8:], strict=True)]
    code = F.when(initial == "s", cases[0]).when(initial == "u", cases[1]).when(initial == "a", cases[2]).otherwise(cases[3])
    seen = stored(at.join(first, ["conv", "pos"], "left").select(
        "conv", "pos", F.expr(f"pos div {chunk}").alias("chunk"), "turn", "role", "text", code.alias("code"), fault.alias("fault")), "repair-rows")

    chunks = stored(seen.groupBy("conv", "chunk").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "").alias("codes")), "repair-chunks")
    settled = stored(converged(chunks), "repair-settled")
    pieces = stored(traced(settled), "repair-edits")

    # pairs inside the chunks, and between a chunk and the next one
    plain = F.translate("codes", CODES, "suax" * 3)
    pairs = chunks.select("conv", "chunk", plain.alias("p"))
    heads = pairs.where("chunk > 0").select("conv", (F.col("chunk") - 1).alias("chunk"), F.substring("p", 1, 1).alias("next"))
    bad = F.expr("size(filter(sequence(1, length(q)), i -> i < length(q) AND substr(q, i, 2) NOT IN ('su', 'ua', 'au')))")
    illegal = pairs.join(heads, ["conv", "chunk"], "left").withColumn("q", F.concat("p", F.coalesce("next", F.lit("")))).groupBy("conv").agg(
        F.sum(bad.cast("long")).alias("illegal"))
    counts = seen.groupBy("conv").agg(
        *[F.count_if(F.col("fault") == f).alias(c) for f, c in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))])
    turn = F.col("turn").cast("long")
    gaps = seen.where("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("_")).groupBy("conv").agg(
        (F.max(turn) - F.min(turn) + 1 - F.count(F.lit(1))).alias("gaps"))
    start = F.when(F.col("chunk") == 0, F.element_at("front", START + 1)).otherwise(0)
    cost = settled.groupBy("conv").agg(F.sum(F.col("total") + start).alias("cost"))
    audit = pieces.groupBy("conv").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("chunk", F.translate("edits", ",", "").alias("e")))), lambda x: x["e"]), "").alias("audit"))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None).cast("string")
    tagged = seen.select("conv", "chunk", "pos", "role", "text", F.lit(None).cast("int").alias("state"), none.alias("edits")).unionByName(
        pieces.select("conv", "chunk", F.lit(-1).cast("long").alias("pos"), none.alias("role"), none.alias("text"), "state", "edits"))
    hashes = tagged.repartition(n, "conv").sortWithinPartitions("conv", "chunk", "pos").mapInArrow(
        _repaired_hash, "conv string, repaired_sha256 string")
    out = counts
    for part in (gaps, illegal, cost, audit, hashes):
        out = out.join(part, "conv", "left")
    return out.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long")))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair_conversations(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per conv_id of ``conversations`` (null is one of them) after the
    damage: see ``damaged`` and ``repair``. A conversation without a row left
    has zeros, an empty audit and the hash of nothing; an empty table gives no
    row. Other columns are not read."""
    all_ = conversations.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).distinct()
    fixed = repair(damaged(conversations), chunk)
    zero = F.lit(0).cast("long")
    return all_.join(fixed, "conv", "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))


def op12_structure_repair(spark, sf_dir: str) -> DataFrame:
    return repair_conversations(read(spark, sf_dir, "conversations"))
