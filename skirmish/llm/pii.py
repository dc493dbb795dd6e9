"""Bootstrapped contextual extraction of personal data.

Seeds are what the base patterns find (email, ip, card, phone). The words
around seeds induce lexical patterns; Spark scores the graph of patterns and
instances in rounds (a pattern by the share of one kind among its known
instances, an instance by its patterns); accepted patterns discover identifiers
that no base pattern matches, which become known in the next round, until a
round finds none.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import fresh, read, stored

# fixed patterns of the base scan
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits, as it would start at the run's first one (so time is linear in a run)
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

HINT = re.compile(r"[0-9@]")
# a run without white space or quotes; one with a digit or @ in it is an identifier-like token
RUN = re.compile(r"[^\s=:;,\"'<>()\[\]{}]+")
# what joins tokens to a run, and the brackets around one
BETWEEN = re.compile(r"(?=.{1,4}\Z)[ \t]*[()\[\]{}]*[ \t]*")
OPEN, CLOSE = "([{", ")]}"
CONTEXT = re.compile(r"\w+|[^\w\s]")
MIN_VALUE = 5       # characters of a value that is no seed: shorter ones say nothing of their own


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each ``@`` (time linear in
    the text, also for a very long run of name characters)."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1      # a name never holds an @
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [("email", s, e) for s, e in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p[-9:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


class Contexts:
    """Neighbouring tokens of the spans of one text, which is split once."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.ends = array("q"), array("q")
        for m in CONTEXT.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def around(self, start: int, end: int) -> tuple[str, str, str]:
        """Two tokens before, one after (whole, lower case; empty at the text's
        edges). A token that the span cuts counts by its part outside."""
        before, i = [], bisect_left(self.starts, start) - 1
        while i >= 0 and len(before) < 2:
            before.append(self.text[self.starts[i]:min(self.ends[i], start)].lower())
            i -= 1
        before += [""] * (2 - len(before))
        j = bisect_right(self.ends, end)
        after = self.text[max(self.starts[j], end):self.ends[j]].lower() if j < len(self.ends) else ""
        return before[1], before[0], after


def instances(text: str, found: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds and identifier-like tokens outside them, with their contexts."""
    out, contexts = [], Contexts(text)
    for kind, s, e in found:
        a, b, c = contexts.around(s, e)
        out.append({"kind": kind, "start": s, "end": e, "value": text[s:e], "before2": a, "before1": b, "after1": c})
    taken = sorted((s, e) for _, s, e in found)
    tokens: list[tuple[int, int, bool]] = []           # start, end, does a sentence end here
    k = 0
    for m in RUN.finditer(text):
        s, e = m.span()
        if not HINT.search(text, s, e):
            continue
        while e > s and text[e - 1] in ".!?":
            e -= 1
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if e > s and not any(t[0] < e and t[1] > s for t in taken[k:k + 3]):
            tokens.append((s, e, e < m.end()))
    spans = [(s, e) for s, e, _ in tokens] + runs(text, tokens)
    for s, e in sorted(spans):
        if e - s >= MIN_VALUE:
            a, b, c = contexts.around(s, e)
            out.append({"kind": None, "start": s, "end": e, "value": text[s:e], "before2": a, "before1": b, "after1": c})
    return out


def runs(text: str, tokens: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """Spans of two or more adjacent tokens with only blanks and brackets
    between them, and a bracket around the run whose partner is inside."""
    out, i = [], 0
    while i < len(tokens):
        j = i + 1
        while j < len(tokens) and not tokens[j - 1][2] and BETWEEN.fullmatch(text[tokens[j - 1][1]:min(tokens[j][0], tokens[j - 1][1] + 5)]):
            j += 1
        if j - i > 1:
            s, e = tokens[i][0], tokens[j - 1][1]
            inner = text[s:e]
            for x, y in zip(OPEN, CLOSE, strict=True):
                if s and text[s - 1] == x and inner.count(y) > inner.count(x):
                    s -= 1
                elif text[e:e + 1] == y and inner.count(x) > inner.count(y):
                    e += 1
            out.append((s, e))
        i = j
    return out


def digest_text(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


INSTANCE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()),
                      ("before2", pa.string()), ("before1", pa.string()), ("after1", pa.string())])
ARROW = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_email", pa.int64()), ("n_ip", pa.int64()),
                   ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("base", pa.string()),
                   ("instances", pa.list_(INSTANCE))])
SCHEMA = ("uid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
          "instances array<struct<kind:string,start:long,end:long,value:string,before2:string,before1:string,after1:string>>")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def scan_base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for uid, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            text = text.as_py() or ""
            row = {"uid": uid, "doc_id": doc_id, "n_email": 0, "n_ip": 0, "n_card": 0, "n_phone": 0,
                   "base_sha256": EMPTY_SHA, "base": "", "instances": []}
            if HINT.search(text):
                found = base_spans(text)
                row["base"] = digest_text(found)
                row["base_sha256"] = hashlib.sha256(row["base"].encode()).hexdigest()
                for kind, _, _ in found:
                    row["n_" + kind] += 1
                row["instances"] = instances(text, found)
            out.append(row)
        yield pa.RecordBatch.from_pylist(out, schema=ARROW)


def discover(marked: DataFrame, rounds: int = 60, min_support: int = 3, min_pattern: float = 0.8,
             min_instance: float = 0.8, min_known: float = 0.5) -> DataFrame:
    """Instances (uid, kind or null, start, end, value, contexts) → newly found
    (uid, kind, start, end, value). A pattern counts distinct values; it is
    accepted with ``min_support`` known values of one kind that make up
    ``min_pattern`` of its known values and ``min_known`` of all its values (a
    context of mostly other things says nothing). A found value keeps its kind;
    rounds go on until none is added, and more than ``rounds`` are an error."""
    inst = marked.select("uid", F.explode("instances").alias("i")).select("uid", "i.*")
    # value → patterns, one row per pair however often the value is repeated
    pattern = F.explode(F.array(
        F.concat_ws(" ", F.lit("2"), "before2", "before1"),
        F.concat_ws(" ", F.lit("1"), "before1", F.lit("_"), "after1")))
    graph = stored(inst.where("before1 <> ''").select(pattern.alias("pattern"), "value", "kind").distinct(), "pii-graph")
    known = graph.where("kind IS NOT NULL").select("value", "kind").distinct()
    seeds = known
    unknown = graph.where("kind IS NULL").select("pattern", "value")
    total = graph.groupBy("pattern").agg(F.countDistinct("value").alias("n"))
    edges = stored(graph.select("pattern", "value").distinct(), "pii-edges")
    learned = None
    for _ in range(rounds):
        met = edges.join(known, "value")
        judged = met.groupBy("pattern").agg(F.countDistinct("value").alias("n_known")).join(total, "pattern")
        by_kind = (met.groupBy("pattern", "kind").agg(F.count("value").alias("hit")).where(F.col("hit") >= min_support).join(judged, "pattern")
                   .where(F.col("hit") >= min_known * F.col("n"))
                   .select("pattern", "kind", (F.col("hit") / F.col("n_known")).alias("p")).where(F.col("p") >= min_pattern))
        accepted = (unknown.join(by_kind, "pattern").groupBy("value", "kind")
                    .agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("p")))))).alias("p"))
                    .where(F.col("p") >= min_instance)
                    .groupBy("value").agg(F.max_by("kind", F.struct("p", "kind")).alias("kind")))
        new = stored(accepted if learned is None else accepted.join(learned.select("value"), "value", "left_anti"), "pii-known")
        none = new.isEmpty()
        learned = new if learned is None else learned.unionByName(new)
        if none:
            break
        known = seeds.unionByName(learned.join(seeds.select("value"), "value", "left_anti"))
    else:
        raise RuntimeError("personal data did not settle")
    return (inst.where("kind IS NULL").drop("kind").join(learned, "value")
            .select("uid", F.concat(F.lit("ctx_"), "kind").alias("kind"), "start", "end", "value"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: base counts, ``base_sha256``, ``spans`` (base, then
    the method's ``ctx_<kind>`` ones) and ``found`` (the method's spans).

    Null and empty texts hold nothing; null ids and repeated rows keep their
    rows (rows are told apart by a row number that is written once); other
    columns are ignored; an empty table gives an empty result. A text is
    handled whole and alone, in time linear in its length, long runs without
    white space included; what is shuffled are identifier-like tokens and
    their context words.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    marked = stored(rows.mapInArrow(scan_base, SCHEMA), "pii-marked")
    found = discover(marked).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("found"))
    text = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return (marked.drop("instances").join(found, "uid", "left")
            .withColumn("spans", F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), text))
            .drop("uid", "base"))


def redact(spans: str, text: str) -> str:
    """``text`` with each listed span replaced by its kind in brackets
    (overlapping spans become one)."""
    if not spans:
        return text
    parts = sorted((int(s), int(e), k.removeprefix("ctx_")) for k, s, e in (x.split(":") for x in spans.split(",")))
    out, done = [], 0
    for s, e, k in parts:
        if s >= done:
            out += [text[done:s], f"[{k}]"]
        done = max(done, e)
    return "".join(out) + text[done:]


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_col: str = "n_chars") -> DataFrame:
    """``docs`` with the found spans of ``text_col`` replaced by their kinds;
    ``n_col``, if there is one, follows a changed text. All rows, columns and
    null texts stay. Rows meet their spans by a hash of id and text (equal rows
    have equal spans); only the spans of documents that hold any are joined."""
    key, spans, new = fresh(docs, "pii_key"), fresh(docs, "pii_spans"), fresh(docs, "pii_text")
    digest = F.xxhash64(F.col(id_col), F.col(text_col))
    found = find_pii(docs.select(digest.alias("doc_id"), F.col(text_col).alias("text")))
    found = stored(found.where("spans <> ''").select(F.col("doc_id").alias(key), F.col("spans").alias(spans)).dropDuplicates([key]), "pii-spans")

    @F.pandas_udf("string")
    def cut(s, t):
        return s.combine(t, redact)

    out = docs.withColumn(key, digest).join(found, key, "left").withColumn(
        new, F.when(F.col(spans).isNotNull(), cut(F.coalesce(F.col(spans), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))).otherwise(F.col(text_col)))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col(new).alias(c))
        elif c == n_col:
            columns.append(F.when(F.col(spans).isNotNull(), F.length(new)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
