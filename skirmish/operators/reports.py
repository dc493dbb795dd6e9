"""Team split, line-up reports and summaries.

Plans are shaped for scale:
* the team split is one ``inline`` generator over a single scan (the
  reference scans twice and unions);
* every report is a hash aggregate with map-side partial aggregation, so a
  hot line-up or a hot role costs one pre-aggregated row per map task;
* the day-team map is joined on a canonical (sorted) key and AQE splits a
  skewed key; the opponent's label is read from the partner row of the same
  match (two rows per match, no skew) instead of a second skewed join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.operators.maintain import match_keys
from skirmish.functions.scalars import start_date, start_time, win_rate

# A (day, team) group is a fixed team when it played more than this many times.
FIXED_TEAM_MIN_EXCLUSIVE = 3


# --------------------------------------------------------------------- G
def size_guard(matches: DataFrame) -> DataFrame:
    """Keep matches whose role_ids cover both teams exactly (Q1 fixed:
    team 2's size comes from team2_kungfu; NULL arrays are dropped)."""
    return matches.where(F.size("role_ids") == F.size("team1_kungfu") + F.size("team2_kungfu"))


def split_team(matches: DataFrame) -> DataFrame:
    """G1: one row per side of each match, with the opponent's ids/classes.

    Columns: match_id, grade, start_time, pvp_type, kungfus, role_ids, won,
    anta_role_ids, anta_kungfus, start_date (+ match_type when present).
    """
    m = size_guard(matches)
    n1, n2 = F.size("team1_kungfu"), F.size("team2_kungfu")
    ids1 = F.slice("role_ids", F.lit(1), n1)
    ids2 = F.slice("role_ids", n1 + 1, n2)

    def side(k1: str, i1: Column, k2: str, i2: Column, me: int) -> Column:
        return F.struct(F.col(k1).alias("kungfus"), i1.alias("role_ids"),
                        (F.col("winner") == me).alias("won"),
                        i2.alias("anta_role_ids"), F.col(k2).alias("anta_kungfus"))

    base = ["match_id", "grade"] + (["match_type"] if "match_type" in matches.columns else []) + ["pvp_type"]
    out = m.select(*base, start_time("start_time").alias("start_time"),
                   F.inline(F.array(side("team1_kungfu", ids1, "team2_kungfu", ids2, 1),
                                    side("team2_kungfu", ids2, "team1_kungfu", ids1, 2))))
    return out.withColumn("start_date", start_date("start_time"))


def show_tags(items: DataFrame) -> DataFrame:
    """The distinct tags of the dictionary."""
    return items.select("tag").distinct()


# --------------------------------------------------------------------- D1–D3
def grade_count(matches: DataFrame) -> DataFrame:
    """Matches per grade, ascending by count (grade breaks ties)."""
    return matches.groupBy("grade").agg(F.count(F.lit(1)).alias("count")).orderBy("count", F.col("grade").asc_nulls_first())


def match_grade(matches: DataFrame, grade: int) -> DataFrame:
    """B1: matches of one grade."""
    return matches.where(F.col("grade") == grade)


def match_count(teams: DataFrame) -> DataFrame:
    """Per line-up, games and wins; most wins first."""
    return (teams.groupBy("kungfus")
            .agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("won")).alias("won"))
            .orderBy(F.col("won").desc(), F.col("kungfus")))


def match_rate(counts: DataFrame, kitems: DataFrame, n: int = 200) -> DataFrame:
    """D3: the first ``n`` line-ups of D2 with their label and win rate."""
    from skirmish.functions.kungfu import lineup_labels

    # label first (a projection over the bounded set of line-ups), so one
    # distributed top-k yields the ordered result without a second sort
    labeled = lineup_labels(counts, "kungfus", kitems).withColumn("rate", win_rate("won", "count", digits=None))
    return labeled.orderBy(F.col("won").desc(), F.col("kungfus")).limit(n)


# --------------------------------------------------------------------- D4
def kungfu_weight(scores: DataFrame, role_kungfus: DataFrame, kitems: DataFrame,
                  min_score: int, match_type: str = "3c") -> DataFrame:
    """Class weights among roles above a score.

    weight = Σ kungfu_count / total_count over qualifying roles, count =
    Σ kungfu_count; joined to the class items by name; avg_count =
    count / weight. Ordered by weight descending.
    """
    s = scores.where((F.col("match_type") == match_type) & (F.col("score") > min_score)) \
              .select("role_id", "match_type", "total_count")
    rk = role_kungfus.select("role_id", "match_type", "kungfu", F.col("total_count").alias("kungfu_count"))
    j = s.join(rk, ["role_id", "match_type"])  # C1
    w = (j.groupBy("kungfu")
         .agg(F.sum(F.try_divide(F.col("kungfu_count").cast("double"), F.col("total_count").cast("double"))).alias("weight"),
              F.sum("kungfu_count").alias("count"))
         .withColumnRenamed("kungfu", "kungfu_en"))
    named = w.join(kitems.select("id", F.col("content").alias("kungfu_en"), "kungfu"), "kungfu_en", "left")
    return (named.withColumn("avg_count", F.try_divide(F.col("count").cast("double"), F.col("weight")))
            .orderBy(F.col("weight").desc(), "kungfu_en"))


# --------------------------------------------------------------------- D5–D11
def day_team_map(teams: DataFrame) -> DataFrame:
    """Per (start_date, sorted role_ids): games together, fixed-team flag."""
    return (teams.groupBy("start_date", F.array_sort("role_ids").alias("role_ids"))
            .agg(F.count(F.lit(1)).alias("count"))
            .withColumn("in_team", F.col("count") > FIXED_TEAM_MIN_EXCLUSIVE))


def label_teams(teams: DataFrame, day_map: DataFrame, strict: bool = False) -> DataFrame:
    """C4 + C5: each team row with its own fixed-team flag (inner join on the
    day and the canonical key) and the opponent's flag (``anta_in_team``).

    ``strict=True`` reproduces the reference's joins on unsorted ids (Q2):
    teams whose ids are not already sorted vanish, and an unsorted opponent
    counts as a non-team (NULL).
    """
    m = day_map.select("start_date", "role_ids", "in_team")
    if strict:
        own = teams.join(m, ["start_date", "role_ids"], "inner")
        anta = m.select("start_date", F.col("role_ids").alias("anta_role_ids"), F.col("in_team").alias("anta_in_team"))
        return own.join(anta, ["start_date", "anta_role_ids"], "left")
    keyed = teams.withColumn("_key", F.array_sort("role_ids"))
    own = keyed.join(m.withColumnRenamed("role_ids", "_key"), ["start_date", "_key"], "inner").drop("_key")
    # The opponent is the other row of the same match: its own flag is the
    # day-map flag of our anta_role_ids, so no second join is needed.
    flag = F.col("in_team").cast("int")
    total = F.sum(flag).over(Window.partitionBy(*match_keys(teams)))
    return own.withColumn("anta_in_team", (total - flag) > 0)


def team_kungfu_report(labeled: DataFrame) -> DataFrame:
    """Per (grade, sorted line-up), split by team/person: count, win,
    vs_team_count, vs_team_win (columns ``team_count`` … ``person_vs_team_win``,
    as a pivot on in_team names them). Only the two counts are 0 when a side
    has no rows; its other cells are NULL, as pivot leaves them (Q7).
    Ordered by team_count + person_count descending.

    Written as conditional aggregates: one grouped aggregate (one shuffle,
    map-side combine) instead of pivot's two aggregation rounds."""
    x = labeled.select("grade", F.array_sort("kungfus").alias("kungfus"), "in_team", "anta_in_team", "won")
    aggs = []
    for label, side in (("team", F.col("in_team")), ("person", ~F.col("in_team"))):
        n = F.count_if(side)
        aggs += [n.alias(f"{label}_count")]
        for name, cond in (("win", F.col("won")), ("vs_team_count", F.col("anta_in_team")),
                           ("vs_team_win", F.col("anta_in_team") & F.col("won"))):
            aggs.append(F.when(n > 0, F.count_if(side & cond)).alias(f"{label}_{name}"))
    order = ["team_count", "team_win", "team_vs_team_count", "team_vs_team_win",
             "person_count", "person_win", "person_vs_team_count", "person_vs_team_win"]
    rep = x.groupBy("grade", "kungfus").agg(*aggs).select("grade", "kungfus", *order)
    return rep.orderBy((F.col("team_count") + F.col("person_count")).desc(), F.col("grade"), F.col("kungfus"))


def team_kungfu_rates(report: DataFrame, kitems: DataFrame) -> DataFrame:
    """Label, total, team weight, person/team win rates and the cross
    pair (1 − person_vs_team/person, team_vs_team/team)."""
    from skirmish.functions.kungfu import lineup_labels

    d = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    r = lineup_labels(report, "kungfus", kitems)
    total = F.col("person_count") + F.col("team_count")
    return r.select(
        "short", "grade", "kungfus",
        total.alias("total_count"),
        F.try_divide(F.col("team_count").cast("double"), total.cast("double")).alias("team_weight"),
        d("person_win", "person_count").alias("person_rate"),
        d("team_win", "team_count").alias("team_rate"),
        F.struct((F.lit(1.0) - d("person_vs_team_count", "person_count")).alias("person"),
                 d("team_vs_team_count", "team_count").alias("team")).alias("cross"),
    )


def top_lineups(rates: DataFrame, grade: int | None = None, order: str = "total_count", n: int = 200) -> DataFrame:
    """F8: the first n line-ups of a grade by ``order`` (descending); with
    ``grade=None`` the first n of every grade at once (row_number per grade;
    a grade holds at most the distinct line-ups, a bounded set)."""
    key = [F.col(order).desc_nulls_last(), F.col("kungfus")]
    if grade is not None:
        return rates.where(F.col("grade") == grade).orderBy(*key).limit(n)
    w = Window.partitionBy("grade").orderBy(*key)
    return rates.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def with_kungfu(report: DataFrame, kungfu_id: int, col: str = "kungfus") -> DataFrame:
    """Rows whose line-up contains a class."""
    return report.where(F.array_contains(col, kungfu_id))


def role_team_weight(day_map: DataFrame) -> DataFrame:
    """Per role, Σ games in fixed teams (``team``) and otherwise
    (``person``); both filled with 0 (Q8); ordered by their sum. One grouped
    aggregate with conditional sums (what the pivot on in_team computes)."""
    x = day_map.select(F.explode("role_ids").alias("role_id"), "in_team", "count")
    zero = F.lit(0).cast("long")
    p = x.groupBy("role_id").agg(
        F.coalesce(F.sum(F.when(F.col("in_team"), F.col("count"))), zero).alias("team"),
        F.coalesce(F.sum(F.when(~F.col("in_team"), F.col("count"))), zero).alias("person"))
    return p.orderBy((F.col("team") + F.col("person")).desc(), "role_id")


def role_team_rate(weights: DataFrame) -> DataFrame:
    """total = team + person, rate = team / total."""
    total = F.coalesce(F.col("team"), F.lit(0)) + F.coalesce(F.col("person"), F.lit(0))
    return weights.withColumn("total", total).withColumn(
        "team_rate", F.try_divide(F.col("team").cast("double"), F.col("total").cast("double")))


def team_repeat_histogram(day_map: DataFrame) -> DataFrame:
    """How many (day, team) groups have each repeat count."""
    return (day_map.groupBy("count").agg(F.count(F.lit(1)).alias("weight"))
            .orderBy(F.col("weight").desc(), "count"))


def weighted_histogram(df: DataFrame, value: str, weight: str, bins: int) -> DataFrame:
    """Σ weight in ``bins`` equal-width bins between min and max of
    value; the maximum falls in the last bin. Bounds are scalar subqueries
    (computed once, no join)."""
    v0 = F.col(value).cast("double")
    # one scalar subquery for both bounds (referenced twice, executed once)
    bounds = df.select(F.struct(F.min(v0).alias("lo"), F.max(v0).alias("hi"))).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    v = F.col(value).cast("double")
    # width_bucket's rule, written out so the bin of an exact edge is fixed
    b = F.when(hi == lo, F.lit(1)).otherwise(
        F.least(F.floor(F.lit(float(bins)) * (v - lo) / (hi - lo)) + 1, F.lit(bins)))
    width = (hi - lo) / bins
    return (df.where(F.col(value).isNotNull())
            .groupBy(b.cast("int").alias("bin"))
            .agg(F.sum(weight).alias("weight"))
            .withColumn("lower", lo + (F.col("bin") - 1) * width)
            .withColumn("upper", lo + F.col("bin") * width)
            .orderBy("bin"))


# --------------------------------------------------------------------- D12–D20
def role_summary(roles: DataFrame, persons: DataFrame, scores: DataFrame) -> DataFrame:
    """Each role with its person's name, fetched_count = Σ non-null
    (0 if none), last fetched_at, and its score lines sorted by match type
    (one per match type: a bounded list)."""
    s = scores.groupBy("role_id").agg(
        F.coalesce(F.sum("fetched_count"), F.lit(0)).alias("fetched_count"),
        F.max("fetched_at").alias("fetched_at"),
        F.array_sort(F.collect_list(F.struct(
            "match_type", "score", "ranking", "total_count",
            win_rate("win_count", "total_count").alias("win_rate")))).alias("scores"))
    p = persons.select("person_id", F.col("name").alias("person_name"))
    r = roles.join(p, "person_id", "left")
    return (r.join(s, r.global_id == s.role_id, "left").drop(s.role_id)
            .withColumn("fetched_count", F.coalesce("fetched_count", F.lit(0))))


def person_summary(persons: DataFrame, roles: DataFrame, nested: bool = False) -> DataFrame:
    """Each person with its roles (global_id, name, force, passport_id).

    The default is one row per (person, role) — no per-person list is ever
    materialised, so an account with very many roles cannot overload a
    task. ``nested=True`` gives the sorted list form for bounded use."""
    r = roles.select("person_id", "global_id", F.col("name").alias("role_name"), "force", "passport_id")
    if not nested:
        return persons.join(r, "person_id", "left")
    g = r.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct(
        "global_id", "role_name", "force", "passport_id"))).alias("roles"))
    return persons.join(g, "person_id", "left")


def summary_counts(roles: DataFrame, persons: DataFrame, matches: DataFrame, scores: DataFrame,
                   match_type: str = "3c") -> DataFrame:
    """One row: roles, persons, matches of a type, fetched scores.
    Each count is a scalar subquery; no join of single-row frames."""
    spark = roles.sparkSession
    cnt = lambda df: df.select(F.count(F.lit(1))).scalar()
    return spark.range(1).select(
        cnt(roles).alias("roles"),
        cnt(persons).alias("persons"),
        cnt(matches.where(F.col("match_type") == match_type)).alias("matches"),
        cnt(scores.where(F.col("fetched_at").isNotNull())).alias("fetched"),
    )


def role_match_count(match_roles: DataFrame, role_id: str | None = None, match_type: str = "3c") -> DataFrame:
    """Matches of a type per role (or of one role)."""
    x = match_roles.where(F.col("match_type") == match_type)
    if role_id is not None:
        x = x.where(F.col("role_id") == role_id)
    return x.groupBy("role_id").agg(F.count(F.lit(1)).alias("count"))


def count_word(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each value of an array column (or a plain one)."""
    dtype = dict(df.dtypes)[col]
    v = F.explode(col) if dtype.startswith("array") else F.col(col)
    return df.select(v.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("count"))


def team_scores(players: DataFrame, score: str = "score2") -> DataFrame:
    """Σ player score per (match, team)."""
    return players.groupBy(*match_keys(players), "team").agg(F.sum(score).alias("team_score"))


def first_skill_count(replays: DataFrame) -> DataFrame:
    """Replays per first skill (NULL for an empty or NULL replay),
    most frequent first."""
    first = F.try_element_at(F.col("replay"), F.lit(1))["skillName"]
    return (replays.select(first.alias("value")).groupBy("value")
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "value"))


def describe(df: DataFrame, *cols: str) -> DataFrame:
    """count/mean/stddev/min/quartiles/max of numeric columns."""
    x = df.select(*cols) if cols else df
    return x.summary("count", "mean", "stddev", "min", "25%", "50%", "75%", "max")


def describe_columns(df: DataFrame, cols: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75), accuracy: int = 10_000) -> DataFrame:
    """D19 with typed columns: one row per column with its non-NULL ``count``,
    exact ``mean``, ``min`` and ``max``, and the ``quantiles`` of ``shares`` by
    a mergeable sketch whose rank error is at most 1 / ``accuracy``. One pass:
    sketches are built per task and merged."""
    def stats(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
                        F.percentile_approx(x, list(shares), accuracy).alias("quantiles"))

    return df.agg(F.array(*[stats(c) for c in cols]).alias("s")).select(F.inline("s"))


def fetched_counts(history: DataFrame) -> DataFrame:
    """Stored matches per role."""
    return history.groupBy("role_id").agg(F.count(F.lit(1)).alias("fetched"))
