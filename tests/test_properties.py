"""Property tests: operators against brute force on small random inputs."""

from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from skirmish.functions.ranges import make_range
from skirmish.operators import maintain as M
from skirmish.operators import ordered as E

BASE = dt.date(2024, 1, 1)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

ranges_st = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20), st.integers(1, 6)), min_size=1, max_size=12)


@SETTINGS
@given(rows=ranges_st)
def test_merge_ranges_is_set_of_days(spark, rows):
    df = spark.createDataFrame([(k, BASE + dt.timedelta(days=s), BASE + dt.timedelta(days=s + n)) for k, s, n in rows],
                               "k int, lo date, up date").select("k", make_range("lo", "up").alias("seen"))
    out = [(r.k, r.seen.lower, r.seen.upper) for r in E.merge_seen_ranges(df, ["k"]).collect()]
    for k in {r[0] for r in rows}:
        want = {BASE + dt.timedelta(days=s + i) for kk, s, n in rows if kk == k for i in range(n)}
        mine = sorted((lo, up) for kk, lo, up in out if kk == k)
        got = {lo + dt.timedelta(days=i) for lo, up in mine for i in range((up - lo).days)}
        assert got == want
        # disjoint and non-adjacent
        assert all(a[1] < b[0] for a, b in zip(mine, mine[1:]))
    again = E.merge_seen_ranges(E.merge_seen_ranges(df, ["k"]), ["k"])
    assert sorted(map(str, again.collect())) == sorted(map(str, E.merge_seen_ranges(df, ["k"]).collect()))


spans_st = st.lists(st.tuples(st.integers(0, 1), st.one_of(st.none(), st.integers(-80, 200)), st.one_of(st.none(), st.integers(1, 140))),
                    min_size=1, max_size=8)


@SETTINGS
@given(rows=spans_st)
def test_merge_ranges_with_open_ends(spark, rows):
    """Half-open and unbounded ranges, runs over several words of the bitmap,
    days before 1970: against a set of days inside a frame that the bounds
    never reach."""
    start = dt.date(1970, 1, 1)
    day = lambda n: None if n is None else start + dt.timedelta(days=n)
    bounds = [(k, lo, None if n is None else (0 if lo is None else lo) + n) for k, lo, n in rows]
    df = spark.createDataFrame([(k, day(lo), day(up)) for k, lo, up in bounds], "k int, lo date, up date").select(
        "k", make_range("lo", "up").alias("seen"))
    res = E.merge_seen_ranges(df, ["k"])
    assert "Window" not in res._jdf.queryExecution().executedPlan().toString()
    frame = range(-500, 500)
    for k in {r[0] for r in rows}:
        want = {x for kk, lo, up in bounds if kk == k for x in frame if (lo is None or lo <= x) and (up is None or x < up)}
        mine = [(r.seen.lower, r.seen.upper) for r in res.where(F.col("k") == k).collect()]
        mine = sorted((-500 if lo is None else (lo - start).days, 500 if up is None else (up - start).days) for lo, up in mine)
        assert {x for lo, up in mine for x in range(lo, up)} == want
        assert all(a[1] < b[0] for a, b in zip(mine, mine[1:], strict=False))


events_st = st.lists(st.tuples(st.sampled_from(["g", "h"]), st.sampled_from([None, "a", "b"]), st.integers(0, 72)),
                     min_size=1, max_size=15)


@SETTINGS
@given(rows=events_st, null_safe=st.booleans())
def test_change_log_matches_sequential_scan(spark, rows, null_safe):
    data = [(i, g, p, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for i, (g, p, h) in enumerate(rows)]
    df = spark.createDataFrame(data, "event_id long, global_id string, passport_id string, inserted_at timestamp_ntz")
    got = sorted((r.global_id, r.passport_id, r.inserted_at) for r in E.passport_changes(df, null_safe=null_safe).collect())
    want = []
    for g in {d[1] for d in data}:
        seq = sorted((d for d in data if d[1] == g), key=lambda d: (d[3], d[0]))
        prev, first = None, True
        for _, _, p, t in seq:
            if p is not None and (first or (p != prev if (null_safe or prev is not None) else False)):
                want.append((g, p, t))
            prev, first = p, False
    assert got == sorted(want)


updates_st = st.lists(st.tuples(st.sampled_from(["k1", "k2", "k3"]), st.one_of(st.none(), st.integers(0, 9)),
                                st.one_of(st.none(), st.sampled_from(["x", "y"]))), min_size=1, max_size=10)


@SETTINGS
@given(ups=updates_st)
def test_upsert_equals_sequential_updates(spark, ups):
    target = {"k1": (1, "t"), "k2": (None, "u")}
    t = spark.createDataFrame([(k, a, b) for k, (a, b) in target.items()], "k string, a int, b string")
    u = spark.createDataFrame([(k, a, b, i) for i, (k, a, b) in enumerate(ups)], "k string, a int, b string, seq int")
    got = {r.k: (r.a, r.b) for r in M.upsert(t, u, ["k"], order="seq").collect()}
    want = dict(target)
    for k, a, b in ups:
        old = want.get(k, (None, None))
        want[k] = (a if a is not None else old[0], b if b is not None else old[1])
    assert got == want


CLASS_IDS = {1: "jingyu", 2: "tianluo", 3: "mowen", 4: "taixu", 5: "xisui"}
lineups_st = st.lists(st.lists(st.sampled_from([1, 2, 3, 4, 5, 99]), min_size=0, max_size=5), min_size=1, max_size=6)


@SETTINGS
@given(lineups=lineups_st)
def test_labels_match_brute_force(spark, lineups):
    from skirmish.functions.kungfu import kungfu_items, lineup_labels
    from skirmish.sources.dimension import CLASS_NAMES, CLASS_ORDER, class_dimension

    items = spark.createDataFrame([("kungfu", str(i), f'"{c}"') for i, c in CLASS_IDS.items()],
                                  "tag string, id string, content string")
    ki = kungfu_items(items, class_dimension(spark))
    df = spark.createDataFrame([(i, ls) for i, ls in enumerate(lineups)], "i int, k array<int>")
    short = {c: sh for c, _, sh in CLASS_NAMES}
    rank = {c: n + 1 for n, c in enumerate(CLASS_ORDER)}

    def brute(ids):
        names = [CLASS_IDS.get(x) for x in ids]

        def key(pair):
            x, name = pair
            if name is None:
                return (1e6, x)
            if name == "jingyu" and "tianluo" in names:
                return (rank["tianluo"] - 0.5, x)
            return (float(rank[name]), x)
        return "".join(short[n] if n else "?" for _, n in sorted(zip(ids, names), key=key))

    want = {i: brute(ls) for i, ls in enumerate(lineups)}
    got = {r.i: r.short for r in lineup_labels(df, "k", ki).collect()}
    assert got == want


@SETTINGS
@given(known=st.lists(st.sampled_from("abcdef"), max_size=4, unique=True),
       seen=st.lists(st.tuples(st.sampled_from("abcdefgh"), st.integers(0, 50)), min_size=1, max_size=12))
def test_dictionary_versions_match_brute_force(spark, known, seen):
    kdf = spark.createDataFrame([("t", v, i) for i, v in enumerate(known)], "tag string, value string, id long")
    vdf = spark.createDataFrame([("t", v, s) for v, s in seen], "tag string, value string, seq long")
    got = {r.value: (r.id, r.is_new) for r in E.dictionary_versions(kdf, vdf, "seq").collect()}
    want = {v: (i, False) for i, v in enumerate(known)}
    first = {}
    for v, s in seen:
        first[v] = min(first.get(v, s), s)
    nxt = len(known)
    for v in sorted((v for v in first if v not in want), key=lambda v: (first[v], v)):
        want[v] = (nxt, True)
        nxt += 1
    assert got == want
