"""Embedding near-dedup against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from skirmish.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, cid string, cell int"


def brute(rows, t=0.98):
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    x = [np.array(v, np.float32).astype(float) if k else None for (_, v, _), k in zip(rows, ok, strict=True)]
    comp, n = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= t:
                n[i] += 1
                n[j] += 1
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    out = []
    for i, (d, _, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if comp[k] == comp[i] and rows[k][0] is not None]
        low = min(ids) if ids else None
        out.append((d, n[i], low, d is not None and d == low))
    return sorted(out, key=repr)


@pytest.mark.parametrize("home,probe", [(256, 1024), (5, 7)])
def test_links_match_brute_force(spark, monkeypatch, home, probe):
    monkeypatch.setattr(E, "HOME", home)
    monkeypatch.setattr(E, "PROBE", probe)
    rng = np.random.default_rng(home)
    rows = []
    for dim, count in ((16, 90), (64, 90), (2, 25)):
        centre = rng.normal(size=(6, dim))
        for _ in range(count):
            v = centre[rng.integers(6)] + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.2, 3])
            rows.append([len(rows), (v * rng.choice([1.0, 5.0])).astype(np.float32).tolist(), int(rng.integers(2))])
    nan, inf = float("nan"), float("inf")
    for v, lab in ((None, 1), ([], 1), ([0.0, 0.0], 1), ([nan, 1.0], 1), ([inf, 1.0], 1), ([None, 1.0], 1), ([1.0, 0.0], None), ([3.0, 0.0], 0), ([1.0, 0.0], 0)):
        rows.append([len(rows), v, lab])
    rows += [list(rows[3]), [None, rows[100][1], rows[100][2]], [None, None, None]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in E.near_duplicates(df).collect()), key=repr)
    assert got == brute(rows)


def test_empty(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_doubles_of_any_size(spark):
    """Equal directions link whatever the size; norms and products of these overflow or vanish unscaled."""
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1.0001e200], 1), (3, [1e-200, 1e-200], 1), (4, [5e-324, 5e-324], 1), (5, [1.7e308, -1.7e308], 1),
            (6, [1e-310, -1e-310], 1), (7, [1.0, 0.0], 1), (8, [1e-320, 0.0], 1), (9, [0.0, 0.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in
           E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (1, 7), 8: (1, 7), 9: (0, 9)}
