"""Landed JSON payloads → table rows.

A payload table has one JSON text per fetched response (column ``payload``)
plus whatever context was known when it was fetched (match type, role id).
Every flattener is ``from_json`` with an explicit schema and
``explode``/``inline`` — JVM-side, one pass, no Python per row. Responses
are bounded by the service (a page of at most a few hundred entries), so a
response is a natural unit of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.functions.scalars import empty_nil, grade_of_score, icon_url_trim, parse_ranking, percent_name

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def arr(t) -> T.ArrayType:
    return T.ArrayType(t)


PERSON = st(("nickName", S), ("avatarUrl", S), ("signature", S))
TOP200_ENTRY = st(("passportId", S), ("globalId", S), ("personId", S), ("personInfo", st(
    ("gameRoleId", S), ("roleName", S), ("server", S), ("zone", S), ("force", S), ("bodyType", S),
    ("person", PERSON))))
PERSON_ROLE = st(("gameGlobalRoleId", S), ("gameRoleId", S), ("passport_id", S), ("name", S), ("server", S),
                 ("zone", S), ("force", S), ("bodily", S), ("level", S), ("valid", B), ("person_id", S),
                 ("person_name", S), ("person_avatar", S))
SKILL = st(("icon", S), ("name", S), ("accuracy", D), ("success_times", L), ("times", L))
ROLE_KUNGFU = st(("name", S), ("skills", arr(SKILL)))
ROLE_BY_GID = st(("personInfo", st(("gameGlobalRoleId", S), ("gameRoleId", S), ("roleName", S), ("server", S),
                                   ("zone", S), ("force", S), ("bodyType", S), ("person", PERSON))),
                 ("passportId", S), ("personId", S))
METRIC_ITEM = st(("grade", I), ("name", S), ("value", S), ("ranking", S))
INDICATOR = st(("type", S), ("metrics", arr(st(("kungfu", S), ("mvp_count", L), ("total_count", L), ("win_count", L),
                                                ("items", arr(METRIC_ITEM))))),
               ("performance", st(("grade", I), ("mmr", I), ("ranking", S), ("total_count", L), ("win_count", L),
                                  ("mvp_count", L))))
ROLE_INDICATOR = st(("person_info", st(("person_id", S), ("person_name", S))),
                    ("role_info", st(("global_role_id", S), ("role_id", S), ("name", S), ("server", S), ("zone", S),
                                     ("force", S), ("body_type", S), ("camp", S), ("person_avatar", S))),
                    ("indicator", arr(INDICATOR)))
CORP = st(("corpsId", S), ("pvpType", I), ("corpsName", S), ("zone", S), ("server", S))
HISTORY = st(("match_id", L), ("global_role_id", S), ("avg_grade", I), ("start_time", L), ("end_time", L),
             ("mvp", B), ("won", B), ("mmr", I), ("total_mmr", I), ("kungfu", I), ("zone", S), ("server", S))
NAMED_VALUE = st(("name", S), ("value", S))
ARMOR = st(("ui_id", S), ("name", S), ("icon", S), ("quality", I), ("strength_level", I), ("strength_evel", I),
           ("permanent_enchant", S), ("temporary_enchant", S), ("mount1", S), ("mount2", S), ("mount3", S),
           ("mount4", S), ("mount5", S), ("pos", I))
TALENT = st(("id", S), ("name", S), ("icon", S), ("level", I))
PLAYER = st(("global_role_id", S), ("role_id", S), ("role_name", S), ("zone", S), ("server", S), ("kungfu_id", I),
            ("kungfu", S), ("mmr", I), ("score", I), ("ranking", S), ("total_count", I), ("win_count", I),
            ("mvp_count", I), ("equip_score", I), ("equip_strength_score", I), ("stone_score", I), ("max_hp", I),
            ("metrics", arr(NAMED_VALUE)), ("armors", arr(ARMOR)), ("talents", arr(TALENT)),
            ("body_qualities", arr(NAMED_VALUE)))
TEAM = st(("won", B), ("players_info", arr(PLAYER)))
MATCH_DETAIL = st(("match_id", L), ("basic_info", st(("start_time", L), ("duration", I), ("map", S), ("type", I),
                                                     ("grade", I))), ("team1", TEAM), ("team2", TEAM))

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's): fields of an armor / talent
# entry that are not part of its dictionary content.
ARMOR_DROPPED = ["strength_evel", "strength_level", "permanent_enchant", "temporary_enchant",
                 "mount1", "mount2", "mount3", "mount4", "mount5", "pos"]
TALENT_DROPPED = ["level"]
# ---------------------------------------------------------------------------


def read_payloads(spark, path: str) -> DataFrame:
    """Landed responses stored as JSON lines (one response per line) under
    ``path``; folder partitions such as ``match_type=3c/`` become columns.
    Returns the ``payload`` text column (plus partition columns)."""
    return spark.read.text(path).withColumnRenamed("value", "payload")


def write_payloads(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append") -> None:
    """Land a payload table as JSON lines (text files) for ``read_payloads``."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.text(path)


def _parse(df: DataFrame, schema, col: str = "payload") -> Column:
    return F.from_json(F.col(col), schema, {"mode": "PERMISSIVE"})


def _role_id_long(c: Column) -> Column:
    """Role id text → LONG; "" → NULL."""
    return empty_nil(c).try_cast("long")


def flatten_top200(df: DataFrame, col: str = "payload") -> DataFrame:
    """(role_info, person_info) per entry of a top-200 response."""
    e = df.select(F.explode(_parse(df, arr(TOP200_ENTRY), col)).alias("e"))
    r, p = F.col("e.personInfo"), F.col("e.personInfo.person")
    return e.select(
        empty_nil("e.passportId").alias("passport_id"), empty_nil("e.globalId").alias("global_id"),
        _role_id_long(r["gameRoleId"]).alias("role_id"), empty_nil(r["roleName"]).alias("name"),
        empty_nil(r["server"]).alias("server"), empty_nil(r["zone"]).alias("zone"),
        empty_nil(r["force"]).alias("force"), empty_nil(r["bodyType"]).alias("body_type"),
        F.lit(None).cast("string").alias("camp"),
        empty_nil("e.personId").alias("person_id"), empty_nil(p["nickName"]).alias("person_name"),
        empty_nil(p["avatarUrl"]).alias("avatar"), empty_nil(p["signature"]).alias("signature"))


def flatten_person_roles(df: DataFrame, col: str = "payload") -> DataFrame:
    """The roles of a person, with level and valid."""
    e = df.select(F.explode(_parse(df, arr(PERSON_ROLE), col)).alias("r")).select("r.*")
    return e.select(
        empty_nil("gameGlobalRoleId").alias("global_id"), _role_id_long(F.col("gameRoleId")).alias("role_id"),
        empty_nil("passport_id").alias("passport_id"), empty_nil("name").alias("name"),
        empty_nil("server").alias("server"), empty_nil("zone").alias("zone"), empty_nil("force").alias("force"),
        empty_nil("bodily").alias("body_type"), F.lit(None).cast("string").alias("camp"), F.col("level").try_cast("int").alias("level"), "valid",
        empty_nil("person_id").alias("person_id"), empty_nil("person_name").alias("person_name"),
        empty_nil("person_avatar").alias("avatar"), F.lit(None).cast("string").alias("signature"))


def flatten_role_kungfus(df: DataFrame, icon_prefix: str, col: str = "payload") -> DataFrame:
    """One row per class of a role: skills with the icon trimmed, name,
    accuracy = success_times when accuracy is set, times."""
    e = df.select("role_id", "match_type", F.explode(_parse(df, arr(ROLE_KUNGFU), col)).alias("k"))
    skills = F.transform(F.coalesce(F.col("k.skills"), F.array().cast(arr(SKILL))), lambda s: F.struct(
        icon_url_trim(s["icon"], icon_prefix).alias("icon"), s["name"].alias("name"),
        F.when(s["accuracy"].isNotNull(), s["success_times"]).alias("accuracy"), s["times"].alias("times")))
    return e.select("role_id", "match_type", F.col("k.name").alias("kungfu"), skills.alias("skills"))


def flatten_role_by_gid(df: DataFrame, col: str = "payload") -> DataFrame:
    """role_info and person_info; no row when personInfo is absent."""
    e = df.select(_parse(df, ROLE_BY_GID, col).alias("d")).where(F.col("d.personInfo").isNotNull())
    p = F.col("d.personInfo")
    return e.select(
        empty_nil(p["gameGlobalRoleId"]).alias("global_id"), _role_id_long(p["gameRoleId"]).alias("role_id"),
        empty_nil("d.passportId").alias("passport_id"), empty_nil(p["roleName"]).alias("name"),
        empty_nil(p["server"]).alias("server"), empty_nil(p["zone"]).alias("zone"),
        empty_nil(p["force"]).alias("force"), empty_nil(p["bodyType"]).alias("body_type"),
        F.lit(None).cast("string").alias("camp"), empty_nil("d.personId").alias("person_id"),
        empty_nil(p["person"]["nickName"]).alias("person_name"), empty_nil(p["person"]["avatarUrl"]).alias("avatar"),
        F.lit(None).cast("string").alias("signature"))


def flatten_role_indicator(df: DataFrame, col: str = "payload"):
    """(roles, persons, performance, class metrics) from indicator
    responses; a response without role_info gives nothing."""
    d = df.select(_parse(df, ROLE_INDICATOR, col).alias("d")).where(F.col("d.role_info").isNotNull())
    r, p = F.col("d.role_info"), F.col("d.person_info")
    roles = d.select(
        F.lit(None).cast("string").alias("passport_id"), empty_nil(r["global_role_id"]).alias("global_id"),
        r["role_id"].try_cast("long").alias("role_id"), empty_nil(r["name"]).alias("name"),
        empty_nil(r["server"]).alias("server"), empty_nil(r["zone"]).alias("zone"),
        empty_nil(r["force"]).alias("force"), empty_nil(r["body_type"]).alias("body_type"),
        empty_nil(r["camp"]).alias("camp"), empty_nil(p["person_id"]).alias("person_id"))
    persons = d.select(empty_nil(p["person_id"]).alias("person_id"), empty_nil(p["person_name"]).alias("name"),
                       empty_nil(r["person_avatar"]).alias("avatar"), F.lit(None).cast("string").alias("signature"))
    ind = d.select(empty_nil(r["global_role_id"]).alias("role_id"), F.explode("d.indicator").alias("i"))
    perf = ind.where(F.col("i.performance").isNotNull()).select(
        "role_id", F.col("i.type").alias("match_type"), F.col("i.performance.grade").alias("grade"),
        F.col("i.performance.mmr").alias("score"), parse_ranking(F.col("i.performance.ranking")).alias("ranking"),
        F.col("i.performance.total_count").alias("total_count"), F.col("i.performance.win_count").alias("win_count"),
        F.col("i.performance.mvp_count").alias("mvp_count"))
    metrics = ind.select("role_id", F.col("i.type").alias("match_type"), F.explode("i.metrics").alias("m")).select(
        "role_id", "match_type", F.col("m.kungfu").alias("kungfu"), F.col("m.mvp_count").alias("mvp_count"),
        F.col("m.total_count").alias("total_count"), F.col("m.win_count").alias("win_count"),
        F.col("m.items").alias("metrics"))
    return roles, persons, perf, metrics


def flatten_corps(df: DataFrame, col: str = "payload") -> DataFrame:
    """Corps of a role: corp_id, pvp_type, name, zone, server."""
    e = df.select(F.explode(_parse(df, arr(CORP), col)).alias("c"))
    return e.select(F.col("c.corpsId").try_cast("long").alias("corp_id"), F.col("c.pvpType").alias("pvp_type"),
                    F.col("c.corpsName").alias("name"), F.col("c.zone").alias("zone"), F.col("c.server").alias("server"))


def flatten_role_history(df: DataFrame, col: str = "payload") -> DataFrame:
    """One row per match of a role's history page (mmr → score_diff,
    total_mmr → score)."""
    e = df.select("match_type", F.explode(_parse(df, arr(HISTORY), col)).alias("m"))
    m = F.col("m")
    return e.select(m["match_id"].alias("match_id"), "match_type", m["global_role_id"].alias("global_id"),
                    m["avg_grade"].alias("avg_grade"), m["start_time"].alias("start_time"),
                    m["end_time"].alias("end_time"), m["mvp"].alias("mvp"), m["won"].alias("won"),
                    m["mmr"].alias("score_diff"), m["total_mmr"].alias("score"), m["kungfu"].alias("kungfu"),
                    m["zone"].alias("zone"), m["server"].alias("server"))


def flatten_match_replay(df: DataFrame, col: str = "payload") -> DataFrame:
    """Replay responses; "no data" (an error response) gives no row;
    skill_cate is dropped (not in the schema); match_type is added."""
    from skirmish.operators.replay import REPLAY_SCHEMA

    ok = df.where(F.col(col).isNotNull() & F.get_json_object(F.col(col), "$.error").isNull())
    return ok.select("match_type", _parse(ok, REPLAY_SCHEMA, col).alias("r")).select("r.*", "match_type")


def _team_players(team: str, n: int) -> Column:
    return F.transform(F.coalesce(F.col(f"d.{team}.players_info"), F.array().cast(arr(PLAYER))),
                       lambda p: F.struct(F.lit(n).alias("team"), p.alias("p")))


def flatten_match_detail(df: DataFrame, col: str = "payload"):
    """One matches row per detail (team score sums, sorted classes,
    winner from team 1's flag) and one match_roles row per player (team,
    grade from score, equip addition, metric/equip/talent/attr arrays).
    Returns (matches, match_roles)."""
    from skirmish.functions.scalars import equip_addition, parse_attrs, winner_of

    d = df.select("match_type", _parse(df, MATCH_DETAIL, col).alias("d")).where(F.col("d.match_id").isNotNull())
    p1 = F.coalesce(F.col("d.team1.players_info"), F.array().cast(arr(PLAYER)))
    p2 = F.coalesce(F.col("d.team2.players_info"), F.array().cast(arr(PLAYER)))
    ssum = lambda ps: F.aggregate(ps, F.lit(0), lambda a, p: a + F.coalesce(p["score"], F.lit(0)))
    matches = d.select(
        F.col("d.match_id").alias("match_id"), "match_type",
        F.col("d.basic_info.start_time").alias("start_time"), F.col("d.basic_info.duration").alias("duration"),
        F.col("d.basic_info.map").try_cast("int").alias("map"), F.col("d.basic_info.type").alias("pvp_type"),
        F.col("d.basic_info.grade").alias("grade"),
        ssum(p1).alias("team1_score"), ssum(p2).alias("team2_score"),
        winner_of(F.col("d.team1.won")).alias("winner"),
        F.array_sort(F.transform(p1, lambda p: p["kungfu_id"])).alias("team1_kungfu"),
        F.array_sort(F.transform(p2, lambda p: p["kungfu_id"])).alias("team2_kungfu"),
        F.concat(F.transform(p1, lambda p: p["global_role_id"]), F.transform(p2, lambda p: p["global_role_id"]))
        .alias("role_ids"))
    players = d.select(F.col("d.match_id").alias("match_id"), "match_type",
                       F.inline(F.concat(_team_players("team1", 1), _team_players("team2", 2))))
    p = F.col("p")
    roles = players.select(
        "match_id", "match_type", "team",
        p["global_role_id"].alias("global_id"), p["role_id"].alias("role_id"), p["role_name"].alias("name"),
        p["zone"].alias("zone"), p["server"].alias("server"), p["kungfu_id"].alias("kungfu"),
        p["mmr"].alias("score"), p["score"].alias("score2"), parse_ranking(p["ranking"]).alias("ranking"),
        grade_of_score(p["score"]).alias("grade"), p["total_count"].alias("total_count"),
        p["win_count"].alias("win_count"), p["mvp_count"].alias("mvp_count"), p["equip_score"].alias("equip_score"),
        equip_addition(p["equip_strength_score"], p["stone_score"]).alias("equip_addition_score"),
        p["max_hp"].alias("max_hp"),
        parse_attrs(F.transform(p["metrics"], lambda m: m["value"])).alias("metrics"),
        F.transform(p["metrics"], lambda m: percent_name(m["name"], m["value"])).alias("metric_names"),
        F.transform(p["armors"], lambda a: a["ui_id"].try_cast("int")).alias("equips"),
        F.transform(p["talents"], lambda t: t["id"].try_cast("int")).alias("talents"),
        parse_attrs(F.transform(p["body_qualities"], lambda m: m["value"])).alias("attrs"),
        F.transform(p["body_qualities"], lambda m: percent_name(m["name"], m["value"])).alias("attr_names"))
    return matches, roles


def collect_dictionary(df: DataFrame, icon_prefix: str, col: str = "payload") -> DataFrame:
    """Dictionary rows met in match details — class names (tag kungfu),
    equips (level/enchant/mount/pos fields dropped, icon trimmed) and
    talents (level dropped, icon trimmed) — one row per (tag, id); the
    metric and attribute name lists go through ``dictionary_versions``."""
    d = df.select(_parse(df, MATCH_DETAIL, col).alias("d"))
    pl = d.select(F.explode(F.concat(F.coalesce(F.col("d.team1.players_info"), F.array().cast(arr(PLAYER))),
                                     F.coalesce(F.col("d.team2.players_info"), F.array().cast(arr(PLAYER)))))
                  .alias("p"))
    kung = pl.select(F.lit("kungfu").alias("tag"), F.col("p.kungfu_id").cast("string").alias("id"),
                     F.concat(F.lit('"'), F.col("p.kungfu"), F.lit('"')).alias("content"))
    keep_armor = [f.name for f in ARMOR.fields if f.name not in ARMOR_DROPPED]
    armor = pl.select(F.explode("p.armors").alias("a")).select(
        F.lit("equip").alias("tag"), F.col("a.ui_id").try_cast("int").cast("string").alias("id"),
        F.to_json(F.struct(*[(icon_url_trim(F.col("a.icon"), icon_prefix) if f == "icon" else F.col(f"a.{f}")).alias(f)
                             for f in keep_armor])).alias("content"))
    keep_talent = [f.name for f in TALENT.fields if f.name not in TALENT_DROPPED]
    talent = pl.select(F.explode("p.talents").alias("t")).select(
        F.lit("talent").alias("tag"), F.col("t.id").try_cast("int").cast("string").alias("id"),
        F.to_json(F.struct(*[(icon_url_trim(F.col("t.icon"), icon_prefix) if f == "icon" else F.col(f"t.{f}")).alias(f)
                             for f in keep_talent])).alias("content"))
    rows = kung.unionByName(armor).unionByName(talent).where(F.col("id").isNotNull())
    return rows.groupBy("tag", "id").agg(F.max("content").alias("content"))


# Scalar fields of a dictionary entry that have one type however they arrive.
TEXT_FIELDS, NUMBER_FIELDS = ["ui_id", "id", "name", "icon"], ["quality"]


def _entry(entry: Column, dropped: list[str], icon_prefix: str) -> Column:
    """A dictionary entry's content as JSON text: every field it came with but
    the ``dropped`` ones, in the order of their names. Known fields get their
    type (a number may arrive as text and the reverse)."""
    def field(k: Column, v: Column) -> Column:
        text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "bigint")
        return (F.when(k == "icon", icon_url_trim(text, icon_prefix).cast("variant"))
                .when(k.isin(TEXT_FIELDS), text.cast("variant"))
                .when(k.isin(NUMBER_FIELDS) & number.isNotNull(), number.cast("variant")).otherwise(v))

    fields = F.try_variant_get(entry, "$", "map<string,variant>")
    return F.to_json(F.transform_values(F.map_filter(fields, lambda k, _v: ~k.isin(dropped)), field))


def dictionary_entries(df: DataFrame, icon_prefix: str, order: list[str], col: str = "payload") -> DataFrame:
    """J10 as it arrives: one (tag, id, content, at) row per class name, equip
    and talent met, ``at`` being its place by the payload's ``order`` columns,
    then by team, seat and position. Payloads are parsed as VARIANT, so fields
    that no schema names stay in the content. Entries without an id, and
    payloads that are no JSON, give nothing. Feed it to ``push_entries``."""
    v = df.select(F.struct(*order).alias("o"), F.try_parse_json(col).alias("v"))
    team = lambda n: F.try_variant_get("v", f"$.team{n}.players_info", "array<variant>")
    none = F.array().cast("array<variant>")
    players = v.select("o", F.posexplode(F.concat(F.coalesce(team(1), none), F.coalesce(team(2), none))).alias("seat", "p"))
    whole = lambda c, path: F.try_variant_get(c, path, "string").try_cast("int").cast("string")
    zero = F.lit(0)
    kung = players.select(F.lit("kungfu").alias("tag"), whole(F.col("p"), "$.kungfu_id").alias("id"),
                          F.concat(F.lit('"'), F.try_variant_get("p", "$.kungfu", "string"), F.lit('"')).alias("content"),
                          F.struct("o", "seat", zero.alias("pos")).alias("at"))
    out = [kung]
    for tag, path, key, dropped in (("equip", "armors", "$.ui_id", ARMOR_DROPPED), ("talent", "talents", "$.id", TALENT_DROPPED)):
        e = players.select("o", "seat", F.posexplode(F.try_variant_get("p", f"$.{path}", "array<variant>")).alias("pos", "e"))
        out.append(e.select(F.lit(tag).alias("tag"), whole(F.col("e"), key).alias("id"), _entry(F.col("e"), dropped, icon_prefix).alias("content"),
                            F.struct("o", "seat", "pos").alias("at")))
    return out[0].unionByName(out[1]).unionByName(out[2]).where(F.col("id").isNotNull() & F.col("content").isNotNull())


def push_entries(dictionary: DataFrame, entries: DataFrame) -> DataFrame:
    """J10's rules over I8: class names overwrite what is there (the last one
    met stays); equips and talents are inserted once (the first one met)."""
    from skirmish.operators.maintain import dictionary_push

    names = F.col("tag") == "kungfu"
    renamed = dictionary_push(dictionary, entries.where(names), "overwrite", order="at")
    return dictionary_push(renamed, entries.where(~names), "insert_only", order="at")


def name_lists(roles: DataFrame) -> DataFrame:
    """The metric / attribute name lists seen (tag, value = list text,
    first = first match id), ready for ``dictionary_versions``."""
    m = roles.select(F.lit("metric_names").alias("tag"), F.array_join("metric_names", "|").alias("value"), "match_id")
    a = roles.select(F.lit("attr_names").alias("tag"), F.array_join("attr_names", "|").alias("value"), "match_id")
    return m.unionByName(a)
