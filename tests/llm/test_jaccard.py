"""N-gram Jaccard join against brute force."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from skirmish.llm import jaccard_join as J

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, size=4):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = WORD.findall((text or "").translate(fold))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, num=85):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= num * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if comp[k] == comp[i] and rows[k][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    return out


def edited(rng, words, k):
    w = list(words)
    for _ in range(k):
        i = int(rng.integers(len(w)))
        op = rng.integers(3)
        if op == 0:
            w[i] = f"e{rng.integers(1000)}"
        elif op == 1 and len(w) > 2:
            del w[i]
        else:
            w.insert(i, f"x{rng.integers(1000)}")
    return w


@pytest.mark.parametrize("seed,chunk", [(0, 512), (1, 4)])
def test_components_match_brute_force(docs_frame, seed, chunk, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", chunk)
    rng = np.random.default_rng(seed)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one TWO"), (5, "one two three"), (6, "É à b c d"), (7, "é à b c d")]
    for base in range(6):
        n = int(rng.integers(4, 160))
        words = [f"w{rng.integers(400)}" for _ in range(n)]
        for _ in range(18):                   # chains of edits: links that are not transitive
            rows.append((len(rows), " ".join(words)))
            words = edited(rng, words, int(rng.integers(0, max(2, n // 60 + 2))))
    rows += [(rows[20][0], rows[20][1]), (None, rows[30][1]), (None, None), (9999, "x " * 50_000)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.similarity_components(docs_frame(rows)).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_empty(docs_frame):
    assert J.similarity_components(docs_frame([])).count() == 0
    assert J.similarity_components(docs_frame([(1, None)])).collect()[0]["component_id"] == 1


def test_linked_sets_share_a_key():
    """Every pair at the threshold meets in a slice, also with empty slices."""
    rng = np.random.default_rng(3)
    rule = J.Sizes(85)
    for n in [*range(1, 40), 60, 99, 150, 333, 1000]:
        for _ in range(20):
            a = rng.integers(1, 1 << 62, n).astype(np.uint64)
            drop = int(rng.integers(0, rule.spread(n, n) + 1))
            add = int(rng.integers(0, rule.spread(n, n) + 1))
            b = np.concatenate([a[drop:], rng.integers(1, 1 << 62, add).astype(np.uint64)])
            if rule.linked(n, len(b), n - drop) and set(a.tolist()) != set(b.tolist()):
                assert set(J.signature(a, rule).tolist()) & set(J.signature(b, rule).tolist()), (n, drop, add)


def test_tree_finds_what_the_bound_allows():
    rng = np.random.default_rng(4)
    rule = J.Sizes(85)
    p = rng.integers(0, 6, (200, 33))
    n, comp = p.sum(axis=1), rng.integers(0, 50, 200)
    tree = J.RTree(p, n, comp)
    for k in range(0, 200, 7):
        want = {m for m in range(200) if comp[m] != comp[k] and np.minimum(p[k], p[m]).sum() >= rule.need(n[k], n[m])}
        assert set(tree.search(p[k], int(n[k]), int(comp[k]), rule).tolist()) == want


def test_keep_one(docs_frame):
    a = "one two three four five six seven eight nine ten"
    rows = [(1, a), (1, a), (2, a), (3, None), (3, None), (4, ""), (5, "other words here"), (None, a)]
    got = J.keep_one(docs_frame(rows), size=5, num=80)
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    assert got.columns == ["doc_id", "text", "lang", "uid", "score"]
    assert [r for r in kept if r[1] != a] == sorted([(3, None), (3, None), (4, ""), (5, "other words here")], key=repr)
    assert len(kept) == 5


def test_points_bound_the_overlap():
    rng = np.random.default_rng(5)
    for n, m, both in [(30, 30, 28), (700, 760, 690), (5000, 5600, 4000), (60, 2, 1)]:
        a = rng.integers(1, 1 << 62, n + m - both).astype(np.uint64)
        p = J.point_matrix([J.group_counts(a[:n]), J.group_counts(a[n - both:])])
        assert both <= np.minimum(p[0], p[1]).sum() <= min(n, m)
    heavy = np.arange(400, dtype=np.uint64) + np.uint64(7 << 50)      # all in one group
    p = J.point_matrix([J.group_counts(heavy), J.group_counts(heavy[:390])])
    assert np.minimum(p[0], p[1]).sum() >= 390


def test_a_pair_comes_from_its_first_common_tree():
    first = np.array([[1, 4, 9], [4, 9], [2, 3], []], dtype=object)
    assert J.earlier(first[0], first[1:], 9, True).tolist() == [True, False, False]
    assert J.earlier(first[0], first[1:], 4, True).tolist() == [False, False, False]
    assert J.earlier(first[0], first[1:], -7, False).tolist() == [True, False, False]
    assert J.earlier(first[3], first[:1], 4, True).tolist() == [False]


def test_points_are_packed_where_they_are_dealt():
    rng = np.random.default_rng(7)
    for n in (0, 1, 40, 300, 2500):
        point = J.group_counts(np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64)))
        small = J.packed(point)
        assert J.unpacked([small, small]) == [point, point]
        assert n < 300 or len(small) < 0.4 * len(point)
    many = J.group_counts(np.full(70_000, 1 << 20, dtype=np.uint64))    # beyond 255 in a group
    assert J.unpacked([J.packed(many)]) == [many]


def test_the_scan_gives_packed_points():
    text = " ".join(f"w{k}" for k in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], ["doc_id", "tkey", "text"])
    (out,) = J._scan(4)(iter([batch]))
    point = out.column(4)[0].as_py()
    assert len(point) < 250                                             # one byte a group: 516
    assert J.point_matrix(J.unpacked([point])).sum() == 397


def test_a_text_is_hashed_for_its_keys_once(spark, docs_frame, monkeypatch):
    hashed, made = spark.sparkContext.accumulator(0), J._keys

    def counted(*a):
        run = made(*a)

        def of(batches):
            for b in run(batches):
                hashed.add(b.num_rows)
                yield b
        return of

    monkeypatch.setattr(J, "_keys", counted)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[:k % 30], f"e{k % 30}", *base])) for k in range(40)] + [(40, ""), (41, "EINS zwei"), (42, "eins zwei"), (43, None)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.similarity_components(docs_frame(rows)).collect())
    assert got == sorted(brute(rows))
    assert hashed.value == len(rows)


def test_sets_of_a_block_are_as_each_alone():
    rng = np.random.default_rng(9)
    for num in (80, 85):
        rule = J.Sizes(num)
        sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 2, 0, 5, 6, 7, 12, 13, 24, 25, 300, 0, 2500, 8, 0)]
        h, first = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
        keys, at = J.signatures(h, first, rule)
        prints = J.fingerprints(h, first)
        for k, own in enumerate(sets):
            assert keys[at[k]:at[k + 1]].tolist() == J.signature(own, rule).tolist()
            assert J.points_of(h, first)[k] == J.group_counts(own)
            assert prints[k] == J.fingerprints(own, np.array([0, len(own)]))[0] and (prints[k] == 0) == (len(own) == 0)
    assert J.points_of(h[:0], first[:1]) == [] and len(J.fingerprints(h[:0], first[:1])) == 0
