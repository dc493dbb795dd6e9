"""Substring and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from skirmish.llm import repeats as R
from skirmish.llm import substring_dedup as S
from skirmish.llm.substring_dedup import remove_repeated_words
from skirmish.llm.suffix_dedup import remove_repeated_bytes


def brute(rows, length, split, join):
    texts = [split(t or "") for _, t in rows]
    n = Counter(tuple(s[i:i + length]) for s in texts for i in range(len(s) - length + 1))
    out = []
    for (d, _), s in zip(rows, texts, strict=True):
        gone = np.zeros(len(s) + 1, dtype=bool)
        for i in range(len(s) - length + 1):
            if n[tuple(s[i:i + length])] > 1:
                gone[i:i + length] = True
        gone = gone[:len(s)]
        runs = sum(1 for i in range(len(s)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(s), int(gone.sum()), runs, hashlib.sha256(join([x for x, g in zip(s, gone, strict=True) if not g])).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, alphabet, n_docs=60):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdé"), int(rng.integers(1, 5))))
    vocab = [word() for _ in range(alphabet)]
    passages = [[str(rng.choice(vocab)) for _ in range(int(rng.integers(5, 90)))] for _ in range(8)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "short")]
    for _ in range(n_docs):
        words = []
        for _ in range(int(rng.integers(1, 6))):
            kind = rng.integers(4)
            if kind == 0:
                words += passages[rng.integers(8)]
            elif kind == 1:                        # a passage cut anywhere
                p = passages[rng.integers(8)]
                a = int(rng.integers(len(p)))
                words += p[a:a + int(rng.integers(1, 80))]
            elif kind == 2:
                words += ["z"] * int(rng.integers(1, 120))
            else:
                words += [str(rng.choice(vocab)) + str(rng.integers(99)) for _ in range(int(rng.integers(1, 60)))]
        rows.append((len(rows), (" " if rng.integers(2) else "\n").join(words)))
    rows += [rows[10], rows[11], (None, rows[12][1]), (None, None), (999, rows[13][1])]
    return rows


@pytest.mark.parametrize("seed,alphabet", [(0, 300), (1, 8)])
def test_words(docs_frame, seed, alphabet):
    rows = corpus(seed, alphabet)
    got = sorted((tuple(r) for r in remove_repeated_words(docs_frame(rows)).collect()), key=repr)
    assert got == brute(rows, 35, lambda t: re.findall("[^\x20\x09-\x0d]+", t), lambda x: " ".join(x).encode())


@pytest.mark.parametrize("seed,alphabet", [(2, 300), (3, 8)])
def test_bytes(docs_frame, seed, alphabet):
    rows = corpus(seed, alphabet, 40)
    got = sorted((tuple(r) for r in remove_repeated_bytes(docs_frame(rows)).collect()), key=repr)
    assert got == brute(rows, 200, lambda t: t.encode(), bytes)


def test_empty(docs_frame):
    assert remove_repeated_words(docs_frame([])).count() == 0
    assert [tuple(r)[1:4] for r in remove_repeated_bytes(docs_frame([(1, None)])).collect()] == [(0, 0, 0)]


@pytest.mark.parametrize("width", [1, 2, 3, 28, 169])
def test_sliding_min(width):
    v = np.random.default_rng(width).integers(0, 1000, 400).astype(np.uint64)
    assert R.sliding_min(v, width).tolist() == [int(v[i:i + width].min()) for i in range(400 - width + 1)]


@pytest.mark.parametrize("words", [True, False])
def test_segments_give_the_same_pieces(words):
    rng = np.random.default_rng(5)
    texts = ["z " * 400, "", "ab", "".join(rng.choice(list("ab "), 5000)), "x" * 900, "".join(rng.choice(list("abcdefg "), 3000))]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    sym = R.Symbols(words=words, length=35 if words else 200, seed=8 if words else 32)
    h, first = sym.of(buf, off)
    whole, small = R.pieces(h, first, sym), R.pieces(h, first, sym, segment=1)
    assert len(whole[0]) > 20 and all(a.tolist() == b.tolist() for a, b in zip(whole, small, strict=True))


def test_a_text_of_more_than_16_mib(docs_frame):
    text = np.random.default_rng(6).integers(97, 123, (1 << 24) + 5000).astype(np.uint8).tobytes().decode()
    rows = [(1, text), (2, text[-300:]), (3, text[(1 << 20) - 150:(1 << 20) + 150]), (4, text[100:250])]
    got = {r["doc_id"]: tuple(r)[1:4] for r in remove_repeated_bytes(docs_frame(rows)).collect()}
    assert got == {1: (len(text), 600, 2), 2: (300, 300, 1), 3: (300, 300, 1), 4: (150, 0, 0)}


def test_repeated_edges_are_joined_to_nonbranching_paths(spark):
    """Texts of edges: 1 2 3 4 5 twice, once more from 3 on (2 branches into 3), and a loop 7 7."""
    texts = {1: [1, 2, 3, 4, 5], 2: [9, 1, 2, 3, 4, 5], 3: [8, 3, 4, 5], 4: [7, 7], 5: [7]}
    rows = [(t, i, w) for t, ws in texts.items() for i, w in enumerate(ws) if w not in (8, 9)]
    links = S.next_links(spark.createDataFrame(rows, "tkey long, at int, window long"))
    assert sorted(tuple(r) for r in links.collect()) == [(2, 1), (4, 3), (5, 4)]
    paths = S.compacted(links)
    assert sorted((r["edge"], r["anc"], r["rank"]) for r in paths.collect()) == [(2, 1, 1), (4, 3, 1), (5, 3, 2)]
    long = spark.range(1, 1000).selectExpr("id AS edge", "id - 1 AS anc")
    assert {(r["anc"], r["rank"] - r["edge"]) for r in S.compacted(long).collect()} == {(0, 0)}
    assert S.compacted(links.limit(0)).count() == 0


def test_spans_are_verified_at_their_source(spark):
    """Occurrences whose hashes agree but whose words don't are no spans."""
    texts = spark.createDataFrame([(1, "a b  c d x"), (2, "y a\tb c d"), (3, "p q r s")], "tkey long, text string")
    occurrences = spark.createDataFrame([(1, 0, 50, 1), (1, 1, 51, 1), (2, 1, 50, 1), (2, 2, 51, 1), (3, 0, 50, 1), (3, 1, 51, 1)],
                                        "tkey long, at int, window long, n long")
    got = sorted(tuple(r) for r in S.path_spans(texts, occurrences, 3).collect())
    assert got == [(1, 0, 4), (2, 1, 4)]
