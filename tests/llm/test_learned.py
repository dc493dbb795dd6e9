"""Quality classifier and benchmark decontamination."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from skirmish.llm import decontaminate as D
from skirmish.llm import quality as Q
from skirmish.llm import words as W

SF = "/root/testdata/sf0.1"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(9, 5)), np.array([0, 2, 5, 9]), np.array([0.0, 1.0, 1.0])
    one = Q.fit(x, first, y, hidden=4, att=3, steps=1, rate=1e-9)
    loss = lambda: -np.mean(y * np.log(one.score(x, first)) + (1 - y) * np.log(1 - one.score(x, first)))
    before = loss()
    better = Q.fit(x, first, y, hidden=4, att=3, steps=200)
    p = better.score(x, first)
    assert -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) < before / 4


def test_quality_held_out_accuracy(spark):
    from skirmish.llm.common import read

    got = {r["doc_id"]: r for r in Q.op9_quality(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in read(spark, SF, "labels").collect()}
    test = [(got[i]["score"], y) for i, y in labels.items() if i in got and got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in list(got)[:200])
    assert len(test) > 100 and np.mean([(s >= 0.7) == bool(y) for s, y in test]) > 0.97


def test_quality_edges(spark, docs_frame):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, "Some text here."), (2, None), (None, ""), (2, None), (3, " \n "), (4, "x" * 3_000_000)]
    d = docs_frame(rows)
    model = Q.train(d, labels)                       # one class only
    out = Q.score(d, model, out_col="q").collect()
    assert len(out) == 6 and {r["q"] for r in out} == {1.0} and out[0]["score"] == 1
    two = Q.train(d, spark.createDataFrame([(1, 1), (3, 0), (4, 0)], "doc_id long, quality int"))
    assert all(0 <= r["q"] <= 1 for r in Q.score(d, two, out_col="q").collect())
    assert Q.train(d.limit(0), labels).constant == 1.0
    assert Q.score(d.limit(0), model, out_col="q").count() == 0


ITEM = "A train leaves Oslo at 45 km per hour and meets Anna after 3 hours so how far did Anna travel in total that day"


def test_reparameterised_question_is_found(spark, docs_frame):
    bench = spark.createDataFrame([(7, ITEM, "x"), (8, "too short", "x"), (9, None, "x")], "item_id long, text string, doc_id string")
    other = ITEM.replace("45", "60").replace("Anna", "Boris").replace("3", "5").replace("Oslo", "Rome")
    mixed = other.replace("Boris travel", "Carla travel")
    rows = [(1, "intro words. " + ITEM + " end"), (2, "x " + other), (3, mixed), (4, None), (5, ""), (None, ITEM), (6, ITEM[:60]), (1, "intro words. " + ITEM + " end"),
            (10, "a train leaves town and nothing else of the kind happens there at all today or ever")]
    got = sorted(((r["doc_id"], r["item_id"], r["verbatim"]) for r in D.contamination(docs_frame(rows), bench).collect()), key=repr)
    assert got == sorted([(1, 7, True), (1, 7, True), (2, 7, False), (None, 7, True)], key=repr)
    assert D.contamination(docs_frame(rows), bench.limit(0)).count() == 0
    assert D.contamination(docs_frame([]), bench).count() == 0


def test_values_of_other_word_counts_and_edits_are_found(spark, docs_frame):
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    longer = ITEM.replace("45", "1,045.5").replace("Oslo", "New York City").replace("Anna", "Mary Ann").replace("3", "4")
    inserted = ITEM.replace("3 hours so", "3 hours or so")
    deleted = ITEM.replace("hours so how", "hours how")
    rows = [(1, longer), (2, inserted), (3, deleted), (4, longer.replace("Mary Ann travel", "Carla Ann travel"))]
    got = sorted((r["doc_id"], r["verbatim"]) for r in D.contamination(docs_frame(rows), bench).collect())
    assert got == [(1, False), (2, True), (3, True)]


def test_alignments_over_neighbouring_shifts():
    item, doc = [0, 1, 2, 5, 6, 7], [10, 11, 12, 16, 17, 18]
    assert [sorted(c) for c in D.alignments(item, doc, 8, 6)] == [[0, 1, 2, 3, 4, 5]]
    assert D.alignments(item, [10, 11, 12, 40, 41, 42], 8, 4) == []                       # too far apart
    assert D.alignments([5, 6, 7, 0, 1, 2], [10, 11, 12, 13, 14, 15], 8, 4) == []         # in another order
    assert D.alignments([3] * 9, list(range(9)), 8, 2) == []                              # one window again and again


def test_short_and_dense_items_are_found_word_for_word(spark, docs_frame):
    items = ["What is the capital of France?", "1 + 2 = 3, 4 + 5 = 9, 10 + 20 = 30, 7 + 8 = 15", "How many people live in New York City?", "Why?", "?!"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(1, "He asked: what is the capital\nof France, and what is the capital of France"), (2, "so " + items[1] + " it is"), (3, "What is the capital of Spain?"),
            (4, "1 + 2 = 3, 4 + 5 = 9, 10 + 20 = 30, 7 + 8 = 16"), (5, "How many people live in Rome now"), (6, "what is the capital"), (7, "of France why"), (None, items[0])]
    got = sorted(((r["doc_id"], r["item_id"], r["n_windows"], r["coverage"], r["verbatim"]) for r in D.contamination(docs_frame(rows), bench).collect()), key=repr)
    assert got == sorted([(1, 0, 1, 1.0, True), (2, 1, 1, 1.0, True), (5, 2, 1, 1.0, False), (7, 3, 1, 1.0, True), (None, 0, 1, 1.0, True)], key=repr)


def test_a_few_conflicting_slots_do_not_hide_an_item(spark, docs_frame):
    fruit = "So yesterday Tom bought 2 apples and 2 oranges from the man at the market and gave half of them to Mary before lunch"
    bench = spark.createDataFrame([(7, ITEM), (8, fruit)], "item_id long, text string")
    rows = [(1, ITEM.replace("did Anna", "did Carla")), (2, fruit.replace("2 apples", "3 apples").replace("2 oranges", "5 oranges").replace("Tom", "Ben")),
            (3, fruit.replace("Tom", "Eve").replace("Mary", "Eve"))]
    got = sorted((r["doc_id"], r["item_id"], r["verbatim"]) for r in D.contamination(docs_frame(rows), bench).collect())
    assert got == [(1, 7, False), (2, 8, False), (3, 8, False)]
    assert not D.consistent({(0, 1, 5, True), (1, 1, 6, True), (2, 2, 2, False)}, 0.8)


def test_a_wrong_second_number_makes_an_item_inconsistent(spark, docs_frame):
    item = "A baker sold 12 loaves in the morning and then he sold another 12 loaves in the evening of that day"
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    rows = [(1, item.replace("12", "30")), (2, item.replace("another 12", "another 45").replace("12", "30")), (3, item)]
    got = sorted((r["doc_id"], r["verbatim"]) for r in D.contamination(docs_frame(rows), bench).collect())
    assert got == [(1, False), (3, True)]
    assert D.consistent({(0, 5, 8, False), (1, 5, 8, False), (2, 5, 8, False), (3, 5, 9, False)}, 0.75)
    assert D.consistent({(0, 5, 8, False), (1, 6, 8, False)}, 1.0)
    assert not D.consistent({(0, 5, 8, False), (1, 5, 5, False)}, 0.75)


def test_small_filter_gives_the_same(spark, docs_frame):
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    rows = [(1, ITEM), (2, "many other words that form windows of their own but match no item at all here")]
    assert [r["doc_id"] for r in D.contamination(docs_frame(rows), bench, filter_blocks=1).collect()] == [1]


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_blocks_keep_words_in_documents(size):
    import pyarrow as pa

    texts = ["ab cd", None, "", "cd", "é\tab  cd", "ab"]
    seen = {}
    for i, j, buf, off in W.blocks(pa.array(texts), size):
        s, e, doc = W.spans(buf, off)
        for h, d, a, b in zip(W.word_hashes(buf, s, e).tolist(), doc.tolist(), s, e, strict=True):
            seen.setdefault(h, set()).add(bytes(buf[a:b]))
            assert bytes(buf[a:b]).decode() in texts[i + d].split()
    assert all(len(v) == 1 for v in seen.values()) and len(seen) == 3
