"""License scans by template markup.

A template is a line of words with markup: ``[[ … ]]`` is an optional region,
``{{n}}`` a replaceable one of up to n words. It is compiled to a token
automaton whose mandatory words must match exactly; a text holds the license
where the automaton accepts some run of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import read

WORD_RE = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# fixed phrases of the base scan
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# what the BSD licenses of two and of three clauses share; what follows tells them apart
BSD = ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
       "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
       "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
       "in the documentation and or other materials provided with the distribution ")
# (label, markup)
TEMPLATES = [
    ("mit", "[[released]] under the [[terms of the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software {{8}} to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 [[0]]"),
    ("cc-by-nc", "licensed under [[a {{2}}]] cc by nc [[{{2}}]]"),
    ("gpl-3", "[[licensed]] under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("gpl-2", "under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("lgpl-3", "under the [[terms of the]] gnu lesser general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("agpl-3", "under the [[terms of the]] gnu affero general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("isc", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"),
    ("epl-2.0", "under the terms of the eclipse public license [[v]] [[version]] 2 0"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("bsd-2-clause", BSD + "this software is provided by"),
    ("bsd-3-clause", BSD + "[[3]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products "
                           "derived from this software without specific [[prior]] written permission"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0"),
]
MARK = re.compile(r"\[\[|\]\]|\{\{(\d+)\}\}|[^\s\[\]{}]+")


def compile_template(markup: str) -> list[list[tuple[str | None, int]]]:
    """States of the automaton: per state its moves (word or None for any word
    or "" for a free move, next state); the last state accepts."""
    states: list[list[tuple[str | None, int]]] = [[]]
    opened: list[int] = []
    for m in MARK.finditer(markup):
        at = len(states) - 1
        if m[0] == "[[":
            states[at].append(("", at + 1))
            states.append([])
            opened.append(at)
        elif m[0] == "]]":
            states[opened.pop()].append(("", at))
        elif m[1]:
            n = int(m[1])
            for k in range(n):
                states[at + k] += [(None, at + k + 1), ("", at + n)]
                states.append([])
        else:
            states[at].append((m[0], at + 1))
            states.append([])
    if opened:
        raise ValueError(f"open region in {markup!r}")
    return states


class Automaton:
    """All templates at once, entered only where a template may start."""

    def __init__(self, templates):
        self.parts = [(label, compile_template(t)) for label, t in templates]
        self.entry: dict[str, list[int]] = {}
        self.free_entry = []
        for k, (_, states) in enumerate(self.parts):
            words, free = set(), False
            for s in self._closure(states, {0}):
                for w, _ in states[s]:
                    if w is None:
                        free = True
                    elif w:
                        words.add(w)
            if free:
                self.free_entry.append(k)
            for w in words:
                self.entry.setdefault(w, []).append(k)

    @staticmethod
    def _closure(states, at: set[int]) -> set[int]:
        todo, seen = list(at), set(at)
        while todo:
            for w, nxt in states[todo.pop()]:
                if w == "" and nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return seen

    def accept(self, words: list[str], i: int, k: int) -> int:
        """Longest accepted run of template k from word i: its end, or -1."""
        states = self.parts[k][1]
        now, end = self._closure(states, {0}), -1
        for j in range(i, len(words) + 1):
            if len(states) - 1 in now:
                end = j
            if j == len(words):
                break
            now = self._closure(states, {nxt for s in now for w, nxt in states[s] if w is None or (w and w == words[j])})
            if not now:
                break
        return end

    def scan(self, words: list[str]) -> list[tuple[str, int, int]]:
        found = []
        for i, w in enumerate(words):
            for k in (*self.entry.get(w, ()), *self.free_entry):
                end = self.accept(words, i, k)
                if end > i:
                    found.append((self.parts[k][0], i, end))
        return found


def scan_text(text: str, automaton: Automaton, phrases: list[tuple[list[str], str]], trigger: re.Pattern):
    """(n_words, base places [(start, label)], template runs [(label, start, end)])."""
    text = text.translate(FOLD)
    if not trigger.search(text):
        return sum(1 for _ in WORD_RE.finditer(text)), [], []
    words = WORD_RE.findall(text)
    base = [(i, label) for p, label in phrases for i, w in enumerate(words) if w == p[0] and words[i: i + len(p)] == p]
    return len(words), base, automaton.scan(words)


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, spans array<struct<label:string,start:long,end:long>>")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per document with its base places, template labels, spans and a
    score: 1 with an accepted template, 0.5 with a base phrase only, else 0.

    Whole texts are scanned, one by one (memory is one text). Null and empty
    texts have no words and no labels; null ids and repeated rows keep their
    rows; other columns are ignored; an empty table gives an empty result.
    """
    split = [(p.split(), label) for p, label in phrases]
    auto = Automaton(templates)
    # a text without any of these words can neither hold a phrase nor enter a template to its end
    needed = {p[-1] for p, _ in split}
    for _, t in templates:
        plain = re.sub(r"\[\[(?:(?!\]\]).)*\]\]|\{\{\d+\}\}", " ", t).split()
        needed.add(max(plain, key=len))
    trigger = re.compile("|".join(map(re.escape, sorted(needed))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n, base, runs = scan_text(text.as_py() or "", auto, split, trigger)
                own, at = {x for _, x in base}, [i for i, _ in base]
                out.append({
                    "doc_id": doc_id, "n_words": n, "n_base": len(base), "first_word": min(at, default=None),
                    "last_word": max(at, default=None), "base_labels": ",".join(sorted(own)),
                    "labels": ",".join(sorted(own | {r[0] for r in runs})),
                    "score": 1.0 if runs else 0.5 if base else 0.0,
                    "spans": [{"label": x, "start": s, "end": e} for x, s, e in runs]})
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)


ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                   ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                   ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).drop("spans")
