"""Hot keys, pruned targets and repeated deliveries: what a small fixture's
rows cannot show is read off partitions, files and plans."""

from __future__ import annotations

import datetime as dt
import os
from statistics import median

import pytest
from pyspark.sql import functions as F

from skirmish.operators import buckets as K
from skirmish.operators import joins as C
from skirmish.operators import maintain as M
from skirmish.operators import ordered as E
from skirmish.operators import replay as P
from skirmish.operators import reports as R
from skirmish.operators import scan
from skirmish.streaming import streams as L

DAY = dt.datetime(2024, 1, 5)


# ------------------------------------------------------------------ scans
def hot_rows(spark, n=6000):
    """One key holds all rows but a few, all on one day."""
    rows = spark.range(n).select(
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).otherwise(F.lit("hot")).alias("global_id"),
        F.when(F.col("id") % 11 == 0, F.lit(None).cast("string")).otherwise((F.col("id") / 9).cast("int").cast("string")).alias("passport_id"),
        (F.lit(DAY).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("inserted_at"), F.col("id").alias("event_id"))
    return rows


@pytest.mark.parametrize("null_safe", [False, True])
def test_change_log_of_a_key_hot_within_a_day(spark, null_safe):
    rows = hot_rows(spark)
    want, last = [], {}
    for r in sorted(rows.collect(), key=lambda r: r.event_id):
        k, v = r.global_id, r.passport_id
        if v is not None and (k not in last or (last[k] != v and (null_safe or last[k] is not None))):
            want.append((k, v, r.inserted_at))
        last[k] = v
    got = E.passport_changes(rows, null_safe=null_safe).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_hot_key_is_spread_over_the_partitions(spark):
    placed = scan.placed(hot_rows(spark), ["global_id"], ["inserted_at", "event_id"], "hot", parts=8)
    sizes = [r["count"] for r in placed.groupBy(scan.PART).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * median(sizes)


def test_the_carry_has_at_most_one_row_a_partition(spark):
    rows = scan.placed(hot_rows(spark), ["global_id"], ["inserted_at"], "hot", parts=8)
    carry = scan.carried(rows, ["global_id"], {"_n": F.count(F.lit(1))}, {"_before": F.sum("_n")})
    parts = [r[scan.PART] for r in carry.collect()]
    assert len(parts) == len(set(parts)) >= 4


def test_numbered_counts_null_keys_and_ties(spark):
    rows = [(None, 1), (None, 1), (None, None), ("a", 3), ("a", 2), *[("b", i // 3) for i in range(300)]]
    df = spark.createDataFrame(rows, "k string, t int")
    got = scan.numbered(df, ["k"], ["t"], parts=7).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.pos):
        by.setdefault(r.k, []).append((r.pos, r.t))
    for k, seen in by.items():
        assert [p for p, _ in seen] == list(range(len(seen)))
        assert [t for _, t in seen] == sorted((t for x, t in rows if x == k), key=lambda t: (t is not None, t))


def test_dictionary_ids_of_a_large_vocabulary(spark):
    values = spark.range(5000).select(F.lit("t").alias("tag"), F.concat(F.lit("v"), (F.col("id") * 7919 % 5000).cast("string")).alias("value"),
                                      F.col("id").alias("seq"))
    known = values.where("seq < 10").select("tag", "value", F.col("seq").alias("id"))
    got = {r.value: (r.id, r.is_new) for r in E.dictionary_versions(known, values, "seq").collect()}
    assert got == {f"v{i * 7919 % 5000}": (i, i >= 10) for i in range(5000)}


# ------------------------------------------------------------------ stored targets
def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_ino for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def folder(path):
    return int(path.split("bucket=")[1].split("/")[0])


def test_a_batch_of_few_keys_rewrites_its_buckets_only(spark, tmp_path):
    t = spark.range(400).select(F.col("id").cast("string").alias("role_id"), F.lit(1).alias("score"), F.col("id").alias("n"))
    table = K.Bucketed(str(tmp_path / "t"), ("role_id",), 16)
    table.write(t)
    before = files(table.path)
    u = spark.createDataFrame([("7", 5, 1), ("7", 6, 2), ("new", None, 3)], "role_id string, score int, seq int")
    touched = K.upsert_stored(table, u, order="seq")
    after = files(table.path)
    assert 1 <= len(touched) <= 2
    assert {folder(p) for p in before.keys() ^ after.keys()} == set(touched)
    assert all(after[p] == i for p, i in before.items() if folder(p) not in touched)
    got = {r.role_id: (r.score, r.n) for r in table.read(spark).collect()}
    assert len(got) == 401 and got["7"] == (6, 7) and got["new"] == (None, None) and got["8"] == (1, 8)
    K.upsert_stored(table, u, order="seq")             # again: nothing changes
    assert {r.role_id: (r.score, r.n) for r in table.read(spark).collect()} == got


def test_only_the_touched_buckets_are_scanned(spark, tmp_path):
    table = K.Bucketed(str(tmp_path / "t"), ("role_id",), 16)
    table.write(spark.range(400).select(F.col("id").cast("string").alias("role_id")))
    x = table.read(spark, [3, 5])
    x.collect()
    assert "PartitionFilters: [bucket" in x._jdf.queryExecution().executedPlan().toString()
    leaves = x._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.head().metrics().apply("numFiles").value() == 2


def test_postings_are_grouped_in_parts_of_bounded_rows(spark, tmp_path):
    from skirmish.operators.trigram import TrigramIndex

    # one file, one task of the scan: its postings are dealt on before they are grouped
    spark.range(400).select(F.col("id").cast("string").alias("global_id"), F.format_string("name %05d", F.col("id") % 390).alias("name")).coalesce(1) \
        .write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    rows = rows.unionByName(rows.where("global_id < '2'"))
    index = TrigramIndex(str(tmp_path / "t"), "global_id", "name", rows.schema, 4, rows_each=25)
    index.write(rows)
    files = [f for _, _, names in os.walk(tmp_path / "t" / "postings") for f in names if f.startswith("part-")]
    assert len({f.split("-")[1] for f in files}) > 8    # by shuffle partitions: at most 4
    postings = spark.read.parquet(str(tmp_path / "t" / "postings"))
    assert postings.count() == postings.select("id", "gram").distinct().count() > 400
    want = rows.where(F.col("name").like("%me 0_1%2%")).collect()
    assert want and sorted(map(tuple, index.search(spark, "me 0_1%2").collect())) == sorted(map(tuple, want))


def test_class_counts_are_dealt_by_lines(spark):
    from skirmish.sources.fixtures import role_kungfus

    lines = spark.range(6000).selectExpr("id div 3 AS l_orderkey", "id % 40 AS l_partkey")
    orders = spark.range(2000).selectExpr("id AS o_orderkey", "id div 2 AS o_custkey", "if(id % 2 = 0, 'F', 'O') AS o_orderstatus")
    part = spark.range(40).selectExpr("id AS p_partkey", "concat('TYPE ', id % 20) AS p_type")
    got = role_kungfus(orders, lines, part, lines_each=200)
    want = (lines.join(orders, F.expr("l_orderkey = o_orderkey")).join(part, F.expr("l_partkey = p_partkey"))
            .groupBy(F.expr("cast(o_custkey AS string) AS role_id"), F.expr("lower(p_type) AS kungfu"))
            .agg(F.expr("count(DISTINCT o_orderkey)"), F.expr("count(DISTINCT if(o_orderstatus = 'F', o_orderkey, NULL))")))
    assert sorted(map(tuple, got.drop("match_type").collect())) == sorted(map(tuple, want.collect()))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 30 and max(sizes) < 2 * 200    # by shuffle partitions: 4 at most


def test_trigram_index_finds_what_a_scan_finds(spark, tmp_path):
    from skirmish.operators.trigram import TrigramIndex, pattern_trigrams

    assert pattern_trigrams("ab%cde_\\%fg") == ["%fg", "cde"]
    words = ["abcd", "xabcy", "ab", "", None, "a%bc", "abc_d", "ABCD", "名字很長的人", "aaaa", "bcabc", "12😀34"]
    rows = spark.createDataFrame([(str(i), words[i % len(words)], i) for i in range(600)] + [(None, "abcd", -1)],
                                 "global_id string, name string, n int")
    index = TrigramIndex(str(tmp_path / "t"), "global_id", "name", rows.schema, 8)
    index.write(rows)
    for q in ["abc", "ab", "", "b%abc", "a_cd", "a\\%bc", "abc\\_", "很長的", "aaa", "2😀3", "nowhere", "%", "abcd%x"]:
        want = sorted(r.n for r in rows.where(F.col("name").like(f"%{q}%") & F.col("global_id").isNotNull()).collect())
        assert sorted(r.n for r in index.search(spark, q).collect()) == want, q
    read = index.postings(spark, ["abc"])
    read.collect()
    plan = read._jdf.queryExecution().executedPlan()
    assert plan.collectLeaves().head().metrics().apply("numFiles").value() <= len(os.listdir(f"{index.path}/postings"))
    assert "(bucket#" in plan.toString() and "EqualTo(gram,abc)" in plan.toString()
    none = TrigramIndex(str(tmp_path / "none"), "global_id", "name", rows.schema, 8)
    none.write(rows.where("false"))
    assert none.search(spark, "abc").count() == 0 == none.search(spark, "a").count()


def test_role_logs_in_buckets(spark, tmp_path):
    rows = [("a", dt.date(2024, 1, 1)), ("a", dt.date(2024, 1, 2)), ("b", dt.date(2024, 1, 1)), (None, dt.date(2024, 1, 1)), ("", dt.date(2024, 1, 1))]
    seen = spark.createDataFrame([(g, None, None, None, None, d) for g, d in rows],
                                 "global_id string, role_id long, name string, zone string, server string, day date")
    none = M.insert_role_logs(seen.where("false").select(*M.KEY_DEFAULTS, F.array().cast("array<struct<lower:date,lower_inclusive:boolean,upper:date,upper_inclusive:boolean>>")
                                                         .alias("seen")), seen.where("global_id = 'b'"))
    table = K.Bucketed(str(tmp_path / "t"), tuple(M.KEY_DEFAULTS), 8)
    table.write(none)
    K.insert_role_logs_stored(table, seen)
    got = {r.global_id: [(s.lower, s.upper) for s in r.seen] for r in table.read(spark).collect()}
    assert got == {"a": [(dt.date(2024, 1, 1), dt.date(2024, 1, 3))], "b": [(dt.date(2024, 1, 1), dt.date(2024, 1, 2))]}
    with pytest.raises(ValueError):
        K.insert_role_logs_stored(K.Bucketed(str(tmp_path / "t"), ("global_id",), 8), seen)


def test_one_choice_of_duplicate(spark):
    new = spark.createDataFrame([(1, "3c", 9, [("r", 1)]), (1, "3c", 4, [("q", 2)])], "match_id long, match_type string, grade int, roles array<struct<role_id:string,team:int>>")
    fresh = M.fresh_rows(new.where("false"), new.repartition(2), ["match_type", "match_id"])
    assert [(r.grade, r.roles[0].role_id) for r in fresh.collect()] == [(4, "q")]


# ------------------------------------------------------------------ the insert stream
MATCH = "match_id long, match_type string, grade int, roles array<struct<global_id:string,role_id:long,team:int>>"


def land(spark, path, k, rows):
    spark.createDataFrame(rows, MATCH).write.parquet(f"{path}/file={k}")


def run(spark, base, **more):
    L.stream_insert_matches(spark, f"{base}/landing/*", spark.createDataFrame([], MATCH).schema, f"{base}/target", f"{base}/ckpt",
                            roles_col="roles", roles_target=f"{base}/roles", fetched_deltas=f"{base}/deltas", width=100, **more).awaitTermination()


def test_stream_counts_account_ids_once(spark, tmp_path):
    base = str(tmp_path)
    a, b = (1, "3c", 5, [("G1", 77, 1), ("G2", 78, 2)]), (1, "2c", 6, [("G1", 77, 1)])
    land(spark, f"{base}/landing", 0, [a, a, b])
    run(spark, base)
    land(spark, f"{base}/landing", 1, [a, (900, "3c", 1, [("G2", 78, 1)])])   # a is delivered again
    run(spark, base)
    land(spark, f"{base}/landing", 2, [(1, "3c", 8, [("G9", 1, 1)])])          # known key, other content: the target has it
    run(spark, base)
    got = sorted((r.match_id, r.match_type, r.grade) for r in L.read_table(spark, f"{base}/target").collect())
    assert got == [(1, "2c", 6), (1, "3c", 5), (900, "3c", 1)]
    scores = spark.createDataFrame([("G1", "3c", 0), ("G2", "3c", 0), ("G1", "2c", 3), ("77", "3c", 0)], "role_id string, match_type string, fetched_count int")
    out = L.apply_fetched_deltas(scores, L.read_table(spark, f"{base}/deltas")).collect()
    assert {(r.role_id, r.match_type): r.fetched_count for r in out} == {("G1", "3c"): 1, ("G2", "3c"): 2, ("G1", "2c"): 4, ("77", "3c"): 0}


def test_redeliveries_are_dropped_by_state(spark, tmp_path):
    base = str(tmp_path)
    for k in range(3):
        land(spark, f"{base}/landing", k, [(1, "3c", 5, [("G1", 77, 1)]), (10 + k, "3c", 5, [("G1", 77, 1)])])
    src = spark.readStream.schema(MATCH).option("maxFilesPerTrigger", 1).parquet(f"{base}/landing/*")
    L.without_redeliveries(src, ["match_type", "match_id"]).writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.match_id for r in spark.read.parquet(f"{base}/out").collect()) == [1, 10, 11, 12]


def test_a_batch_does_not_scan_the_whole_target(spark, tmp_path):
    path = str(tmp_path / "target")
    rows = spark.range(1000).select(F.col("id").alias("match_id"), F.lit("3c").alias("match_type"))
    L.seed(rows, path, width=100)
    x = L.target_slice(spark, path, 1, rows.where("match_id in (150, 160, 720)"), rows.schema, width=100)
    assert sorted({r.match_id // 100 for r in x.collect()}) == [1, 7]
    plan = x._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [" in plan.toString() and "ids#" in plan.toString().split("PartitionFilters: [")[1].split("]")[0]
    scanned = plan.collectLeaves().head().metrics().apply("numPartitions").value()
    assert scanned == 2


# ------------------------------------------------------------------ ids that repeat across types
def test_same_id_in_two_types(spark):
    m = spark.createDataFrame([(1, "2c", ["a", "b", "c", "d"], [1, 2], [1, 2]), (1, "3c", ["e", "f", "g", "h"], [1, 2], [1, 2])],
                              "match_id long, match_type string, role_ids array<string>, team1_kungfu array<int>, team2_kungfu array<int>")
    logs = spark.createDataFrame([(1, "3c", '{"match_duration": 5, "replay": []}')], "match_id long, match_type string, replay string")
    r = P.replay_with_match(P.parse_replay(logs), m).collect()
    assert [(x.match_type, x.team1_ids) for x in r] == [("3c", ["e", "f"])]
    players = spark.createDataFrame([(1, "2c", 1, 50), (1, "3c", 1, 60)], "match_id long, match_type string, team int, score2 int")
    assert {x.match_type: x.team_score for x in R.team_scores(players).collect()} == {"2c": 50, "3c": 60}
    detail = m.select("match_id", "match_type", F.array(F.struct(F.lit("z").alias("role_id"), F.col("match_type"))).alias("players"))
    assert sorted(x.match_type for x in C.participant_of(detail, "z").collect()) == ["2c", "3c"]


# ------------------------------------------------------------------ keyset pages
@pytest.mark.parametrize("desc,nulls_last", [(True, True), (True, False), (False, True), (False, False)])
def test_pages_by_cursor_equal_pages_by_offset(spark, desc, nulls_last):
    from skirmish.operators.keyset import Key, pages

    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 7, "x") for i in range(53)], "id long, score int, o string")
    keys = [Key("score", desc, nulls_last), Key("id")]
    whole = [tuple(r) for r in df.orderBy(*[k.sort() for k in keys]).collect()]
    got = [[tuple(r) for r in p.collect()] for p in pages(df, keys, 10)]
    assert got == [whole[i:i + 10] for i in range(0, 53, 10)]


def test_a_late_page_sorts_one_page(spark, tmp_path):
    from skirmish.operators.keyset import Key, page_after

    spark.range(5000).select(F.col("id"), (F.col("id") % 100).cast("int").alias("score")).write.parquet(str(tmp_path / "t"))
    x = page_after(spark.read.parquet(str(tmp_path / "t")), [Key("score", desc=True), Key("id")], 20, (50, 1050))
    assert [tuple(r) for r in x.collect()][:2] == [(1150, 50), (1250, 50)]
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=20" in plan
    assert "LessThan(score,50)" in plan.split("PushedFilters")[1]
    with pytest.raises(ValueError):
        page_after(x, [Key("id")], 0)


# ------------------------------------------------------------------ dictionary entries
def test_entries_keep_unknown_fields_and_one_type(spark):
    from skirmish.sources import payloads as J

    def detail(name, armor, talent='{"id": 5, "name": "t", "level": 3}'):
        return f'{{"team1": {{"players_info": [{{"kungfu_id": 7, "kungfu": "{name}", "armors": [{armor}], "talents": [{talent}]}}]}}}}'

    rows = [(1, detail("first", '{"ui_id": "9", "quality": "3", "new": [1, {"deep": null}], "pos": 1}')),
            (2, detail("second", '{"ui_id": 9, "quality": 3, "new": "changed"}, {"name": "no id"}')),
            (3, "no json"), (4, None), (5, '{"team1": {}}')]
    e = J.dictionary_entries(spark.createDataFrame(rows, "seq int, payload string"), "http://x/", ["seq"])
    empty = spark.createDataFrame([], "tag string, id string, content string")
    once = J.push_entries(empty, e)
    want = {("kungfu", "7"): '"second"', ("equip", "9"): '{"new":[1,{"deep":null}],"quality":3,"ui_id":"9"}', ("talent", "5"): '{"id":"5","name":"t"}'}
    assert {(r.tag, r.id): r.content for r in once.collect()} == want
    late = e.where("at.o.seq = 1")                                         # an earlier payload comes again
    again = {(r.tag, r.id): r.content for r in J.push_entries(once, late).collect()}
    assert again == want | {("kungfu", "7"): '"first"'}


# ------------------------------------------------------------------ reports
def test_a_run_written_twice_is_there_once(spark, tmp_path):
    from skirmish.sources import sinks as S

    path = str(tmp_path / "docs")
    docs = spark.createDataFrame([("a", ["1"]), ("b", ["2"])], "tag string, content array<string>")
    S.replace_report_set(docs, path, "r1")
    S.replace_report_set(docs, path, "r2")
    S.replace_report_set(docs.where("tag = 'a'").withColumn("content", F.array(F.lit("9"))), path, "r1")
    got = sorted((r.run, r.tag, r.content) for r in spark.read.parquet(path).collect())
    assert got == [("r1", "a", ["9"]), ("r1", "b", ["2"]), ("r2", "a", ["1"]), ("r2", "b", ["2"])]


def test_described_quantiles_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(i, None if i % 2 else float(i)) for i in range(1001)], "a int, b double")
    got = {r["column"]: r for r in R.describe_columns(df, ["a", "b"]).collect()}
    assert (got["a"]["count"], got["a"].mean, got["a"].quantiles[1]) == (1001, 500.0, 500.0)
    assert (got["b"]["count"], got["b"].min, got["b"].max) == (501, 0.0, 1000.0)
    none = R.describe_columns(df.limit(0), ["a"]).collect()[0]
    assert none["count"] == 0 and none.mean is None and none.quantiles is None
