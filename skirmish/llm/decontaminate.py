"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question keeps its
template when its values change; a number with its separators and a run of name
words are one placeholder. Windows of the templates are hashed; a Bloom filter
of fixed size lets only likely benchmark windows leave a document, an exact hash
join finds the items, their windows are chained over neighbouring shifts, and
most slots (the values behind the placeholders) must be replaced consistently
along one alignment. Items without such a window are met by all their words.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm import words as W
from skirmish.llm.common import BlockedBloom, mix64, read, stored
from skirmish.llm.repeats import hash_range

WINDOW = 8          # tokens of a template window
LITERAL = 4         # of which at least so many are no placeholders
COVER = 0.5         # share of an item's windows that an alignment must hold
AGREE = 0.75        # share of an alignment's slots that must be consistent: one of four may differ
SLACK = 8           # tokens by which the shift may change from one held window to the next
# fixed list of unit words
UNITS = ("mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec min h hr hrs ms us ns hz khz mhz ghz w kw mw v kv a ma pa kpa bar j kj cal kcal "
         "c f k usd eur gbp dollars euros pounds cents percent meter meters metre metres kilometers kilometres miles inches feet yards grams "
         "kilograms tons liters litres seconds minutes hours days weeks months years degrees").split()


def _hash_words(items: list[str]) -> np.ndarray:
    buf = np.frombuffer(" ".join(items).encode(), np.uint8)
    s, e, _ = W.spans(buf, np.array([0, len(buf)]), W.WORD)
    return W.word_hashes(buf, s, e, W.FOLDED)


UNIT_HASHES = np.sort(_hash_words(UNITS))
NUM, NAME, UNIT, PLAIN = mix64(np.array([11, 22, 33, 44], dtype=np.uint64))
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[10, 33, 46, 58, 63]] = True      # line feed ! . : ?
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[39, 44, 46, 47, 58]] = True  # ' , . / : between the digits of one number
_APART = np.ones(256, dtype=bool)
_APART[[32, 9, 45]] = False             # blanks and hyphens join the words of a name


def templates(buf: np.ndarray, off: np.ndarray):
    """Per token: the hash of its value, its template token, whether that is a placeholder, and its
    document. A token is a word, a whole number or a run of name words. Then per word: its hash and
    its document."""
    s, e, doc = W.spans(buf, off, W.WORD)
    h = W.word_hashes(buf, s, e, W.FOLDED)
    if len(s) == 0:
        return h, h, np.zeros(0, bool), doc, h, doc
    new_doc = np.ones(len(s), dtype=bool)
    new_doc[1:] = doc[1:] != doc[:-1]
    number = _DIGIT[buf[s]]
    stops = np.concatenate([[0], np.cumsum(_STOP[buf])])
    gap = np.zeros(len(s), dtype=bool)                       # a sentence starts here
    gap[1:] = stops[s[1:]] > stops[e[:-1]]
    second = buf[np.minimum(s + 1, len(buf) - 1)]
    name = _UPPER[buf[s]] & (e - s > 1) & ~_UPPER[second] & ~gap & ~new_doc
    after = np.zeros(len(s), dtype=bool)
    after[1:] = number[:-1] & ~new_doc[1:]
    unit = after & ~number & (UNIT_HASHES[np.minimum(np.searchsorted(UNIT_HASHES, h), len(UNIT_HASHES) - 1)] == h)
    token = h.copy()
    token[name], token[unit], token[number] = NAME, UNIT, NUM
    apart = np.concatenate([[0], np.cumsum(_APART[buf])])
    joins = np.zeros(len(s), dtype=bool)                     # goes on with the value of the word before
    joins[1:] = ~new_doc[1:] & (number[1:] & number[:-1] & (s[1:] - e[:-1] == 1) & _SEPARATOR[buf[e[:-1]]]
                                | name[1:] & name[:-1] & (apart[s[1:]] == apart[e[:-1]]))
    head = np.flatnonzero(~joins)
    end = np.append(head[1:], len(s))
    value, many = h[head], end - head > 1
    value[many] = W.window_sums(h, head[many], end[many])
    return value, token[head], (name | unit | number)[head], doc[head], h, doc


def windows(token, slot, doc, size: int, literal: int, ranged):
    """(start, hash) of all windows of ``size`` tokens inside one document with
    at least ``literal`` tokens that are no placeholders; ``ranged`` is the
    tokens' ``hash_range``."""
    n = len(token) - size + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64)
    starts = np.arange(n)
    filled = np.concatenate([[0], np.cumsum(~slot)])
    starts = starts[(doc[:n] == doc[size - 1:]) & (filled[size:] - filled[:-size] >= literal)]
    return starts, ranged(starts, starts + size)


HIT = "uid long, pos long, h long, slots array<long>, places array<int>, names array<boolean>, size int, plain boolean"
HIT_ARROW = pa.schema([("uid", pa.int64()), ("pos", pa.int64()), ("h", pa.int64()), ("slots", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())),
                       ("names", pa.list_(pa.bool_())),
                       ("size", pa.int32()), ("plain", pa.bool_())])


def _hits(uid, i: int, starts, hashes, size: int, doc, first, h=None, slot=None, token=None):
    """HIT rows of the windows from ``starts``: of plain words if ``slot`` is None."""
    for p, x in zip(starts.tolist(), hashes.view(np.int64).tolist(), strict=True):
        at = np.zeros(0, np.int64) if slot is None else np.flatnonzero(slot[p:p + size])
        yield {"uid": uid[i + int(doc[p])], "pos": p - int(first[doc[p]]), "h": x, "slots": [] if slot is None else h[p + at].view(np.int64).tolist(),
               "places": at.tolist(), "names": [] if slot is None else (token[p + at] == NAME).tolist(), "size": size, "plain": slot is None}


def _window_rows(sizes: list[tuple[int, bool]], literal: int, held=None, whole: int = 0):
    """mapInArrow function (uid, text) → HIT rows of all windows of the listed
    (size, plain): of the template, or of the plain words (one row per document
    and hash, without slots). With ``held`` only windows that the filter may
    hold; with ``whole`` a text without a window also gives one of its whole
    length by its plain words, and one of its template if it has ``whole`` words
    or more and its placeholders alone leave it too short."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, out = b.column(0).to_pylist(), []
            for i, _, buf, off in W.blocks(b.column(1)):
                h, token, slot, doc, word, word_doc = templates(buf, off)
                of_token, of_word = hash_range(token), hash_range(word)
                first, first_word = (W.word_bounds(d, len(off) - 1) for d in (doc, word_doc))
                seen = np.zeros(len(off) - 1, dtype=bool)
                for size, plain in sizes:
                    if plain:
                        starts, hashes = windows(word, np.zeros(len(word), bool), word_doc, size, 0, of_word)
                        hashes = hashes ^ PLAIN
                    else:
                        starts, hashes = windows(token, slot, doc, size, literal, of_token)
                        seen[doc[starts]] = True
                    if held is not None:
                        keep = held.value.may_hold(hashes)
                        starts, hashes = starts[keep], hashes[keep]
                    if plain:
                        _, one = np.unique(np.stack([word_doc[starts].astype(np.uint64), hashes]), axis=1, return_index=True)
                        out += _hits(uid, i, starts[one], hashes[one], size, word_doc, first_word)
                    else:
                        out += _hits(uid, i, starts, hashes, size, doc, first, h, slot, token)
                for d in np.flatnonzero(~seen).tolist() if whole else ():
                    p, n = first_word[d:d + 1], int(first_word[d + 1] - first_word[d])
                    if n:
                        out += _hits(uid, i, p, of_word(p, p + n) ^ PLAIN, n, word_doc, first_word)
                    p, size = first[d:d + 1], int(first[d + 1] - first[d])
                    if size < whole <= n and np.count_nonzero(~slot[p[0]:p[0] + size]) >= literal:
                        out += _hits(uid, i, p, of_token(p, p + size), size, doc, first, h, slot, token)
            yield pa.RecordBatch.from_pylist(out, schema=HIT_ARROW)
    return run


def alignments(item_pos: list[int], pos: list[int], slack: int, need: float) -> list[list[int]]:
    """Chains of hits (window of the item, window of the document) that hold at
    least ``need`` windows: all hits of one shift, and the longest chains whose
    positions increase on both sides with shifts that change by at most
    ``slack`` from hit to hit."""
    order = sorted(range(len(pos)), key=lambda i: (pos[i], item_pos[i]))
    held: dict[int, tuple[list[int], list[int]]] = {}        # shift → positions in the document, hits
    size, back, ends = [1] * len(pos), [-1] * len(pos), set(order)
    for i in order:
        shift, rank = pos[i] - item_pos[i], (0, 0)
        for t in range(shift - slack, shift + slack + 1):
            if t in held:
                # the last hit of this shift before i on both sides is the end of its longest chain
                k = bisect_right(held[t][0], min(pos[i], item_pos[i] + t) - 1) - 1
                if k >= 0 and (size[j := held[t][1][k]], -abs(t - shift)) > rank:
                    rank, back[i] = (size[j], -abs(t - shift)), j
        size[i] += rank[0]
        ends.discard(back[i])
        places, hits = held.setdefault(shift, ([], []))
        places.append(pos[i])
        hits.append(i)
    out = [hits for _, hits in held.values() if len(hits) >= need]
    for i in ends:
        if size[i] >= need:
            chain = [i]
            while back[chain[-1]] >= 0:
                chain.append(back[chain[-1]])
            if len({pos[k] - item_pos[k] for k in chain}) > 1:
                out.append(chain)
    return out


def consistent(slots: set[tuple[int, int, int, bool]], agree: float) -> bool:
    """Whether the share ``agree`` of the slots is consistent. A name is if it is
    unchanged, or stands for one document value which stands for it alone. Of
    the places of one quantity (a number or unit) those are that hold its most
    frequent replacement; two quantities may become equal by chance."""
    to, of, many = {}, {}, {}
    for _, i, d, name in slots:
        if name:
            to.setdefault(i, set()).add(d)
            of.setdefault(d, set()).add(i)
        else:
            many.setdefault(i, Counter())[d] += 1
    names = sum(name and (i == d or len(to[i]) == len(of[d]) == 1) for _, i, d, name in slots)
    return names + sum(max(n.values()) for n in many.values()) >= agree * len(slots)


VERDICT = "uid long, doc_id long, item long, n_windows long, coverage double, n_slots int, verbatim boolean"
VERDICT_ARROW = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("item", pa.int64()), ("n_windows", pa.int64()), ("coverage", pa.float64()),
                           ("n_slots", pa.int32()), ("verbatim", pa.bool_())])


def _verdicts(cover: float, slack: int, agree: float):
    """mapInArrow function (uid, doc_id, item, n_item, hits) → a row per alignment that counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for uid, doc_id, item, n_item, hits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for chain in alignments([x["item_pos"] for x in hits], [x["pos"] for x in hits], slack, cover * n_item):
                    slots = {(p["at"], p["i"], p["d"], p["name"]) for k in chain for p in hits[k]["pairs"]}
                    same = sum(all(p["i"] == p["d"] for p in hits[k]["pairs"]) for k in chain)
                    if same >= cover * n_item or consistent(slots, agree):
                        out.append({"uid": uid, "doc_id": doc_id, "item": item, "n_windows": len(chain), "coverage": len(chain) / n_item,
                                    "n_slots": len(slots), "verbatim": all(i == d for _, i, d, _ in slots)})
            yield pa.RecordBatch.from_pylist(out, schema=VERDICT_ARROW)
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", size: int = WINDOW, literal: int = LITERAL, cover: float = COVER,
                  filter_blocks: int = 1 << 17, slack: int = SLACK, agree: float = AGREE) -> DataFrame:
    """One row per contaminated document and benchmark item: doc_id, item_id,
    n_windows (of the best alignment), coverage, n_slots, verbatim (all slot
    values equal), uid (the document's row).

    An alignment is a chain of common windows in increasing order, in which the
    shift between token positions changes by at most ``slack`` from one window
    to the next. It counts where it holds at least ``cover`` of the item's
    windows and the share ``agree`` of its slots is consistent (see
    ``consistent``), or where its windows with unchanged slots alone reach
    ``cover``. An item
    without a window of ``size`` tokens with ``literal`` plain ones has one
    window of its whole length, which a document must hold word for word (no
    slots are listed); one of ``size`` words or more that only its collapsed
    values make too short is met by its whole template, too. Items without a
    word cannot match. Null and empty texts, an empty benchmark and empty
    documents give no rows; repeated documents or items each give their rows
    (rows with one id and item are listed once per document row); other columns
    are ignored. The filter has ``filter_blocks`` 64-bit words whatever the
    benchmark's size: a larger benchmark only lets more windows pass on to the
    exact join.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.monotonically_increasing_id().alias("uid"), F.col(item_text_col).cast("string").alias("text"),
                             F.col(item_col).cast("long").alias("item_id"))
    items = stored(items, "bench-items")
    bench = stored(items.select("uid", "text").mapInArrow(_window_rows([(size, False)], literal, whole=size), HIT), "bench-windows")
    sizes = sorted({(size, False), *((r["size"], r["plain"]) for r in bench.select("size", "plain").distinct().collect())})
    held = spark.sparkContext.broadcast(BlockedBloom.build(bench, "h", filter_blocks))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(text_col).cast("string").alias("text"),
                       F.col(id_col).cast("long").alias("doc_id"))
    hits = (rows.mapInArrow(_with_id(_window_rows(sizes, literal, held)), HIT + ", doc_id long"))
    b = bench.select(F.col("uid").alias("item"), F.col("pos").alias("item_pos"), F.col("h").alias("item_h"),
                     F.col("slots").alias("item_slots"), F.col("names").alias("item_names"))
    n_item = bench.groupBy(F.col("uid").alias("item")).agg(F.countDistinct("pos").alias("n_item"))
    joined = hits.join(b, hits.h == b.item_h)
    pairs = F.arrays_zip(F.transform("places", lambda p: p + F.col("item_pos")).alias("at"), F.col("item_slots").alias("i"), F.col("slots").alias("d"), F.col("item_names").alias("name"))
    met = (joined.select("uid", "doc_id", "item", F.struct("item_pos", "pos", pairs.alias("pairs")).alias("hit"))
           .groupBy("uid", "doc_id", "item").agg(F.collect_list("hit").alias("hits")).join(n_item, "item")
           # no alignment holds more windows than were met at all
           .where(F.size(F.array_distinct(F.transform("hits", lambda x: x["item_pos"]))) / F.col("n_item") >= cover)
           .select("uid", "doc_id", "item", "n_item", "hits"))
    verdict = met.mapInArrow(_verdicts(cover, slack, agree), VERDICT)
    best = verdict.groupBy("uid", "doc_id", "item").agg(
        F.max(F.struct("n_windows", "coverage", "n_slots", "verbatim")).alias("b"))
    return (best.join(items.select(F.col("uid").alias("item"), "item_id"), "item")
            .select("doc_id", "item_id", "b.n_windows", "b.coverage", "b.n_slots", "b.verbatim", "uid"))


def _with_id(rows):
    """Carry the third column (doc_id) of each input row to its window rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = dict(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))
            for out in rows(iter([b])):
                yield out.append_column("doc_id", pa.array([ids[u] for u in out.column(0).to_pylist()], pa.int64()))
    return run


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("uid")
