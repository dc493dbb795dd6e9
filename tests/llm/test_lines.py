"""Line dedup against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from skirmish.llm.line_dedup import drop_common_lines

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(x.lower() if "A" <= x <= "Z" else x for x in line.strip(WS))


def brute(rows, min_docs):
    lines = [(t or "").split("\n") for _, t in rows]
    n = Counter(k for ls in lines for k in {key(x) for x in ls} if k)
    out = []
    for (d, _), ls in zip(rows, lines, strict=True):
        keep = [x for x in ls if n[key(x)] < min_docs]
        out.append((d, "\n".join(keep), len(ls), len(ls) - len(keep)))
    return sorted(out, key=repr)


def corpus(seed):
    rng = np.random.default_rng(seed)
    lines = ["Footer", "  footer\t", "FOOTER\r", "Überall", "überall", "", " ", "K", "K", "x ", "x  ", "\x85", "İ", "straße", " "]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "Footer")]
    for i in range(80):
        body = [lines[rng.integers(len(lines))] if rng.integers(2) else f"own {rng.integers(60)}" for _ in range(int(rng.integers(1, 9)))]
        rows.append((i + 10, "\n".join(body)))
    # a text of many lines, repeated rows, and rows without an id
    rows += [(500, "\n".join(f"own {k % 70}" for k in range(3000))), rows[20], rows[20], (None, rows[21][1]), (None, None), (None, None)]
    return rows


@pytest.mark.parametrize("seed,min_docs", [(0, 10), (1, 3), (2, 2)])
def test_lines(docs_frame, seed, min_docs):
    rows = corpus(seed)
    docs = docs_frame(rows).withColumnRenamed("uid", "line_row")
    got = drop_common_lines(docs, min_docs=min_docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr) == brute(rows, min_docs)


def test_no_rows(docs_frame):
    assert drop_common_lines(docs_frame([(1, "a")]).limit(0)).count() == 0


def test_nothing_python(docs_frame):
    from skirmish.llm.line_dedup import drop_common_lines as run

    plan = run(docs_frame([(1, "a\nb")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_digest_of_the_query(spark):
    from skirmish.llm.line_dedup import op11_line_dedup

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, g in brute(rows, 10))
    assert sorted(map(tuple, op11_line_dedup(spark, sf).collect())) == want
