"""E / F: window and order-dependent operators.

Hot keys: every per-key window here is either bounded by the domain (a
match's seats, a tag's vocabulary), pre-reduced
before the shuffle (top-n per key gets Spark's partial WindowGroupLimit;
"first/last per key" is a ``max_by`` aggregate with map-side combine), or
spread over range partitions (the change log E8 and the dictionary ids E10 are
segmented scans with one carry per partition, see ``operators.scan``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions.ranges import make_range
from skirmish.operators.scan import carried, numbered, placed, with_carry
from skirmish.session import written


# --------------------------------------------------------------------- E2–E4
def last_n_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key by ``order``. The ``row_number ≤ n``
    filter lets Spark insert a partial per-task group limit before the
    shuffle, so a hot key ships at most n rows per map task."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def kungfu_usage_per_role(recent: DataFrame, kitems: DataFrame | None = None, pick: str = "most") -> DataFrame:
    """Per role, class frequencies as a list sorted by (count, class
    name, class id) — names from the class items, an unknown class has a
    NULL name and sorts first among equal counts — plus the head class:
    the most used (``pick="most"``, default; ties → first by name) or the
    least used (``"least"``, the reference's ascending head, Q11). A role with
    no matches has no row (Q19). The list is bounded by the classes."""
    c = recent.where(F.col("kungfu").isNotNull()).groupBy("role_id", "kungfu").agg(F.count(F.lit(1)).alias("count"))
    if kitems is not None:
        names = kitems.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("kungfu")).agg(
            F.min("content").alias("name"))
        c = c.join(names, "kungfu", "left")
    else:
        c = c.withColumn("name", F.lit(None).cast("string"))
    g = c.groupBy("role_id").agg(F.array_sort(F.collect_list(F.struct("count", "name", "kungfu"))).alias("usage"))
    if pick == "least":
        head = F.element_at("usage", 1)
    elif pick == "most":
        best = F.array_max(F.transform("usage", lambda u: u["count"]))
        head = F.element_at(F.filter("usage", lambda u: u["count"] == best), 1)
    else:
        raise ValueError("pick must be 'most' or 'least'")
    return g.withColumn("head_kungfu", head["kungfu"]).withColumn("head_name", head["name"])


def search_kungfu(top: DataFrame, usage: DataFrame, kungfu, limit: int = 100) -> DataFrame:
    """Of the top roles (C7 over ``search`` roles), those whose head class
    is ``kungfu`` (a class name, or an id when an int is given), best first,
    at most ``limit``."""
    col = "head_kungfu" if isinstance(kungfu, int) else "head_name"
    u = usage.where(F.col(col) == kungfu).select("role_id", "head_kungfu", "head_name")
    return top.join(u, "role_id", "inner").orderBy("position").limit(limit)


# --------------------------------------------------------------------- E5
def infer_teams(match_roles: DataFrame, matches: DataFrame) -> DataFrame:
    """E5: recover role_ids of matches from the participant rows.

    Participants ordered by inserted_at (role_id breaks ties); the first
    size(team1_kungfu) form team 1. Accepted ("fixed") only when the sizes,
    the sorted classes of both teams and both score sums agree with the
    match; otherwise the status names the first failed check. Per match the
    list is bounded by the seats.
    """
    from skirmish.operators.maintain import match_keys

    keys = match_keys(match_roles, matches)
    p = match_roles.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("inserted_at", "role_id", "kungfu", "score2"))).alias("_p"))
    m = matches.select(*keys, "team1_kungfu", "team2_kungfu", "team1_score", "team2_score")
    x = m.join(p, keys, "inner")
    n1, n2 = F.size("team1_kungfu"), F.size("team2_kungfu")
    t1 = F.slice("_p", F.lit(1), F.greatest(n1, F.lit(1)))
    t2 = F.slice("_p", n1 + 1, F.greatest(n2, F.lit(1)))
    classes = lambda t: F.array_sort(F.transform(t, lambda e: e["kungfu"]))
    total = lambda t: F.aggregate(t, F.lit(0).cast("long"), lambda acc, e: acc + F.coalesce(e["score2"], F.lit(0)))
    status = (F.when(F.size("_p") != n1 + n2, F.lit("size_mismatch"))
              .when((classes(t1) != F.array_sort("team1_kungfu")) | (classes(t2) != F.array_sort("team2_kungfu")),
                    F.lit("kungfu_mismatch"))
              .when(~(total(t1).eqNullSafe(F.col("team1_score")) & total(t2).eqNullSafe(F.col("team2_score"))), F.lit("score_mismatch"))
              .otherwise(F.lit("fixed")))
    return x.select(*keys, F.transform("_p", lambda e: e["role_id"]).alias("role_ids"), status.alias("status"))


# --------------------------------------------------------------------- E6–E7
def _shift(name: str, value: Column, bits: Column) -> Column:
    return F.call_function(name, value, bits)


def seen_bitmaps(ranges: DataFrame, keys: list[str], col: str = "seen") -> DataFrame:
    """The days of each key's ranges as a mergeable bitmap: one row per key and
    word of 64 days (``_word``, ``_bits``), combined by ``bit_or`` before and
    after the shuffle. A half-open range has no last word: the smallest day
    from which every day is in is ``_from``, the largest day before which
    every day is in is ``_to`` (both on a row without a word)."""
    lo, up = F.unix_date(f"{col}.lower"), F.unix_date(f"{col}.upper")
    r = (ranges.where(F.col(col).isNotNull())
         .select(*keys, lo.alias("_lo"), up.alias("_up")))
    closed = F.col("_lo").isNotNull() & F.col("_up").isNotNull()
    everything = F.col("_lo").isNull() & F.col("_up").isNull()
    words = F.when(closed, F.sequence(F.shiftright("_lo", 6), F.shiftright(F.col("_up") - 1, 6)))
    x = r.select(*keys, "_lo", "_up", F.explode_outer(words).alias("_word"))
    first = F.greatest(F.col("_lo") - F.col("_word") * 64, F.lit(0))
    last = F.least(F.col("_up") - F.col("_word") * 64, F.lit(64))
    ones = F.lit(-1).cast("long")
    bits = _shift("shiftleft", ones, first).bitwiseAND(_shift("shiftrightunsigned", ones, F.lit(64) - last))
    start = F.when(everything, F.lit(0)).when(~closed & F.col("_up").isNull(), F.col("_lo"))
    end = F.when(everything, F.lit(0)).when(~closed & F.col("_lo").isNull(), F.col("_up"))
    return (x.select(*keys, "_word", F.when(F.col("_word").isNotNull(), bits).alias("_bits"),
                     start.alias("_from"), end.alias("_to"))
            .groupBy(*keys, "_word").agg(F.bit_or("_bits").alias("_bits"), F.min("_from").alias("_from"),
                                         F.max("_to").alias("_to")))


def _days_of(words: Column, bits: str) -> Column:
    """The day numbers of the set bits of sorted words."""
    return F.flatten(F.transform(words, lambda w: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: _shift("shiftright", w[bits], i).bitwiseAND(F.lit(1).cast("long")) == 1),
        lambda i: w["_word"] * 64 + i)))


def merge_seen_ranges(ranges: DataFrame, keys: list[str], col: str = "seen") -> DataFrame:
    """Merge overlapping and day-adjacent ranges per key. Input: one
    canonical range per row in ``col``; output: one row per merged range.

    Ranges become words of a day bitmap, merged by ``bit_or`` with map-side
    combine, so a hot key ships one row per word and task, and no key is
    sorted. A key's list holds its distinct words (six a year). A run starts
    at a set bit after an unset one and ends at a set bit before an unset one;
    starts and ends pair up in order. A closed range costs its words (a year
    six, all years the calendar has some 57,000)."""
    per_key = seen_bitmaps(ranges, keys, col).groupBy(*keys).agg(
        F.array_sort(F.filter(F.collect_list(F.struct("_word", "_bits")), lambda w: w["_word"].isNotNull())).alias("_ws"),
        F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    ws = F.col("_ws")
    one = F.lit(1).cast("long")

    def edges(w: Column, i: Column) -> Column:
        before, after = F.get(ws, i - 1), F.get(ws, i + 1)
        joined = F.coalesce((before["_word"] == w["_word"] - 1) & (before["_bits"] < 0), F.lit(False)).cast("int").cast("long")
        goes_on = F.coalesce((after["_word"] == w["_word"] + 1) & (after["_bits"].bitwiseAND(one) == 1), F.lit(False)).cast("int").cast("long")
        b = w["_bits"]
        opens = b.bitwiseAND(F.bitwise_not(F.shiftleft(b, 1).bitwiseOR(joined)))
        closes = b.bitwiseAND(F.bitwise_not(F.shiftrightunsigned(b, 1).bitwiseOR(F.shiftleft(goes_on, 63))))
        return F.struct(w["_word"].alias("_word"), opens.alias("_opens"), closes.alias("_closes"))

    runs = (per_key.withColumn("_edges", F.transform(ws, edges))
            .withColumn("_runs", F.zip_with(_days_of(F.col("_edges"), "_opens"), _days_of(F.col("_edges"), "_closes"),
                                            lambda a, b: F.struct(a.alias("_lo"), (b + 1).alias("_up")))))
    start, end = F.col("_from"), F.col("_to")
    # runs that touch a half-open range belong to it
    start = F.least(start, F.array_min(F.transform(F.filter("_runs", lambda r: r["_up"] >= F.col("_from")), lambda r: r["_lo"])))
    end = F.greatest(end, F.array_max(F.transform(F.filter("_runs", lambda r: r["_lo"] <= F.col("_to")), lambda r: r["_up"])))
    opened = (runs.withColumn("_start", F.when(F.col("_from").isNotNull(), start))
              .withColumn("_end", F.when(F.col("_to").isNotNull(), end)))
    none = F.lit(None).cast("int")
    apart = F.filter("_runs", lambda r: (F.col("_from").isNull() | (r["_up"] < F.col("_from")))
                     & (F.col("_to").isNull() | (r["_lo"] > F.col("_to"))))
    pair = lambda a, b: F.array(F.struct(a.alias("_lo"), b.alias("_up")))
    no_run = F.slice(pair(none, none), 1, 0)
    out = F.when(F.col("_start") <= F.col("_end"), pair(none, none)).otherwise(F.concat(
        F.when(F.col("_end").isNotNull(), pair(none, F.col("_end"))).otherwise(no_run), apart,
        F.when(F.col("_start").isNotNull(), pair(F.col("_start"), none)).otherwise(no_run)))
    g = opened.select(*keys, F.explode(out).alias("_run"))
    return g.select(*keys, make_range(F.date_from_unix_date("_run._lo"), F.date_from_unix_date("_run._up")).alias(col))


def add_seen_days(ranges: DataFrame, days: DataFrame, keys: list[str], day: str = "day",
                  col: str = "seen") -> DataFrame:
    """Add days to each key's range set: a day inside stays, an adjacent
    day extends, a bridging day joins two ranges, else it is a new range."""
    d = days.select(*keys, make_range(F.col(day), F.date_add(F.col(day), 1)).alias(col))
    from skirmish.operators.maintain import split_by_keys

    r = ranges.select(*keys, col)
    # only keys that got a day are re-merged; the others pass through as they are
    touched, untouched = split_by_keys(r, d.select(*keys).distinct(), keys)
    return untouched.unionByName(merge_seen_ranges(touched.unionByName(d), keys, col))


def seen_sets(merged: DataFrame, keys: list[str], col: str = "seen") -> DataFrame:
    """Collect merged ranges into the sorted ``seen`` array (role_logs form;
    bounded: merged ranges of one key are disjoint)."""
    return merged.groupBy(*keys).agg(F.array_sort(F.collect_list(col)).alias(col))


# --------------------------------------------------------------------- E8
def change_log(df: DataFrame, key: str, value: str, order: list[str], null_safe: bool = False) -> DataFrame:
    """E8 (general form): rows where ``value`` is logged for its key — the
    first row of the key, or a row whose value differs from the previous
    row's (by ``order``); the logged value is never NULL.

    Default (``null_safe=False``) compares with ``<>``, so NULL → value is
    not logged (Q13); ``null_safe=True`` logs it.

    Skew: a segmented scan (``operators.scan``). Rows are range-partitioned by
    (key, order), so a key that is hot within one instant's neighbourhood is
    spread too; a partition's first key takes its previous value from the last
    row that an earlier partition has of it.
    """
    at = F.struct(F.col(value).alias("v"))
    rows = placed(df, [key], order, "change-log", {"_prev_row": F.lag(at)})
    carry = carried(rows, [key], {"_l": F.max_by(at, F.struct(*order))}, {"_prev_part": F.last("_l")})
    y = with_carry(rows, carry, [key])
    prev = F.coalesce(F.col("_prev_row"), F.col("_prev_part"))
    first = prev.isNull()
    changed = ~F.col(value).eqNullSafe(prev["v"]) if null_safe else (F.col(value) != prev["v"])
    keep = F.col(value).isNotNull() & (first | F.coalesce(changed, F.lit(False)))
    return y.where(keep).select(*df.columns)


def passport_changes(updates: DataFrame, null_safe: bool = False) -> DataFrame:
    """Passport log rows (global_id, passport_id, inserted_at)."""
    x = change_log(updates, "global_id", "passport_id", ["inserted_at", "event_id"], null_safe=null_safe)
    return x.where(F.col("global_id").isNotNull()).select("global_id", "passport_id", "inserted_at")


# --------------------------------------------------------------------- E9–E11
def latest_score2(history: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Per role, score2 of the newest stored match (by start_time, then
    match_id) — a ``max_by`` aggregate, reduced map-side."""
    order = order or ["start_time", "match_id"]
    return history.groupBy("role_id").agg(F.max_by("score2", F.struct(*order)).alias("score2"))


def dictionary_versions(known: DataFrame, values: DataFrame, order: str, tag: str = "tag",
                        value: str = "value") -> DataFrame:
    """Dense ids from 0 per tag in first-seen order: known values keep
    their ids; new distinct values get max(id)+1, +2, … by first appearance.
    Output: tag, value, id, is_new.

    New values are ranked by a segmented scan (``operators.scan``): range
    partitions, a count per (partition, tag), and the counts of the earlier
    partitions added up, so a large vocabulary is spread over all tasks."""
    firsts = values.groupBy(tag, value).agg(F.min(order).alias("_first"))
    new = firsts.join(known.select(tag, value), [tag, value], "left_anti")
    base = written(known.groupBy(tag).agg(F.max("id").cast("long").alias("_base")), "dictionary-base")  # a row per tag
    ranked = numbered(new, [tag], ["_first", value], "_rank", "dictionary").join(base, tag, "left")
    rank = F.coalesce(F.col("_base"), F.lit(-1).cast("long")) + 1 + F.col("_rank")
    return (known.select(tag, value, F.col("id").cast("long").alias("id"), F.lit(False).alias("is_new"))
            .unionByName(ranked.select(tag, value, rank.alias("id"), F.lit(True).alias("is_new"))))


def score_history(perf_updates: DataFrame) -> DataFrame:
    """Every score observation that carries a score (append log)."""
    cols = [c for c in ["role_id", "match_type", "score", "grade", "ranking", "total_count", "win_count",
                        "mvp_count", "inserted_at"] if c in perf_updates.columns]
    rows = perf_updates.where(F.col("score").isNotNull())
    if dict(rows.dtypes).get("ranking") == "string":
        from skirmish.functions.scalars import parse_ranking

        rows = rows.withColumn("ranking", parse_ranking("ranking"))
    return rows.select(*cols)


# --------------------------------------------------------------------- F
def order_by_seen(role_logs: DataFrame, col: str = "seen") -> DataFrame:
    """role log rows ordered by their range array (element-wise by
    lower, bounds, upper), NULL arrays last."""
    from skirmish.functions.ranges import range_sort_key

    return role_logs.orderBy(F.transform(col, range_sort_key).asc_nulls_last(), "global_id")


def roles_page(roles: DataFrame, limit: int = 200, offset: int = 0, where=None) -> DataFrame:
    """the roles list page (B11), total order by global_id."""
    from skirmish.operators.filters import paged

    return paged(roles, [F.col("global_id")], where=where, limit=limit, offset=offset)
