"""H: scalar column functions, all built from Spark built-ins (JVM-side).

Every function takes and returns ``Column``s so it composes inside a
``select``/``where`` and stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's).
# Zone name prefixes → match-type zone family; anything else is "m".
ZONE_PREFIXES = [("电信", "c"), ("双线", "d")]
ZONE_OTHER = "m"
# Seconds per unit for ``is_recent``.
TIME_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 24 * 3600, "week": 7 * 24 * 3600}
# Grade from score: trunc(score / 100) − 10, clamped to [0, 13].
GRADE_MIN, GRADE_MAX = 0, 13
# ---------------------------------------------------------------------------


# A float at the very start of a text: sign, digits, optional fraction with
# digits, optional exponent (group 1 is the number).
NUMBER_PREFIX = r"^([+-]?\d+(\.\d+)?([eE][+-]?\d+)?)"


def trim_quotes(c: ColumnOrName) -> Column:
    """H1: strip ``"`` from both ends of a JSON string literal."""
    return F.btrim(_c(c), F.lit('"'))


def empty_nil(c: ColumnOrName) -> Column:
    """H3: empty string → NULL."""
    return F.nullif(_c(c), F.lit(""))


def pad_int(c: ColumnOrName, width: int) -> Column:
    """H4: left-pad an integer with zeros; longer values are kept whole
    (Spark's ``lpad`` alone would cut them)."""
    s = _c(c).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def compact_timestamp(c: ColumnOrName) -> Column:
    """H5: ``yyyyMMddHHmmssSSS`` text of a timestamp (session zone UTC)."""
    return F.date_format(_c(c), "yyyyMMddHHmmssSSS")


def icon_url_trim(c: ColumnOrName, prefix: str) -> Column:
    """H6: path after ``prefix`` without the query string; other text unchanged."""
    import re

    # the prefix may occur anywhere in the text; the path stops at "?"
    pattern = re.escape(prefix) + r"([^?]*)"
    col = _c(c)
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, 1)).otherwise(col)


def percent_name(name: ColumnOrName, value: ColumnOrName) -> Column:
    """H7: name followed by the text after the leading number of value
    (``("crit", "12.5%")`` → ``"crit%"``); a NULL value keeps the name."""
    v = _c(value)
    rest = F.regexp_extract(v, NUMBER_PREFIX + r"(.*)$", 4)
    return F.when(v.isNull(), _c(name)).otherwise(F.concat(_c(name), rest))


def zone_suffix(zone: ColumnOrName) -> Column:
    """H8: NULL/"" → ""; zone starting with a known prefix → its family; else m."""
    z = _c(zone)
    out = F.when(z.isNull() | (z == ""), F.lit(""))
    for prefix, fam in ZONE_PREFIXES:
        out = out.when(z.startswith(prefix), F.lit(fam))
    return out.otherwise(F.lit(ZONE_OTHER))


def zone_suffix_sql(zone: ColumnOrName) -> Column:
    """H8, the SQL twin used by the match-type recode: *contains* a known
    prefix → its family; everything else, NULL included, → m."""
    z = _c(zone)
    out = None
    for prefix, fam in ZONE_PREFIXES:
        cond = z.contains(prefix)
        out = F.when(cond, F.lit(fam)) if out is None else out.when(cond, F.lit(fam))
    return F.coalesce(out.otherwise(F.lit(ZONE_OTHER)), F.lit(ZONE_OTHER))


def default_match_type(zone: ColumnOrName) -> Column:
    """H9: ``3`` + zone family; ``3c`` when the zone is unknown."""
    suffix = zone_suffix(zone)
    return F.when(suffix == "", F.lit("3c")).otherwise(F.concat(F.lit("3"), suffix))


def pvp_type(match_type: ColumnOrName) -> Column:
    """Leading integer of the match type, else 0."""
    lead = F.regexp_extract(_c(match_type), r"^([+-]?\d+)", 1)
    return F.coalesce(F.nullif(lead, F.lit("")).try_cast("int"), F.lit(0))


def parse_ranking(c: ColumnOrName) -> Column:
    """Integer text stays; ``"12%"`` → −12; ``"-"`` or anything else → NULL."""
    s = F.trim(_c(c).cast("string"))
    pct = s.endswith("%")
    num = F.regexp_replace(s, "%$", "")
    return (F.when(s == "-", F.lit(None).cast("int"))
            .when(pct, -(num.try_cast("int")))
            .otherwise(s.try_cast("int")))


def parse_attrs(c: ColumnOrName) -> Column:
    """Array of numeric texts → doubles (leading number of each)."""
    return F.transform(_c(c), lambda x: F.nullif(F.regexp_extract(x, NUMBER_PREFIX, 1), F.lit("")).try_cast("double"))


EPOCH_DATE = "1970-01-01"


def epoch_micros(ts: ColumnOrName) -> Column:
    """Microseconds since 1970-01-01 00:00 of a wall-clock (UTC) timestamp.
    Built from the date and time-of-day fields, so the session time zone
    (and its DST rules) never enters."""
    t = _c(ts).cast("timestamp_ntz")
    days = F.datediff(F.to_date(t), F.lit(EPOCH_DATE).cast("date")).cast("long")
    sod = (F.hour(t) * 3600 + F.minute(t) * 60).cast("long")
    frac = (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")
    return (days * 86400 + sod) * 1_000_000 + frac


def epoch_seconds(ts: ColumnOrName) -> Column:
    """Whole seconds since the epoch of a wall-clock (UTC) timestamp."""
    return F.floor(epoch_micros(ts) / 1_000_000).cast("long")


def start_time(epoch_seconds_col: ColumnOrName) -> Column:
    """Epoch seconds → timestamp (UTC wall clock, no zone attached),
    independent of the session time zone."""
    s = _c(epoch_seconds_col).cast("long")
    days = F.floor(s / 86400).cast("long")
    rem = s - days * 86400
    d = F.date_add(F.lit(EPOCH_DATE).cast("date"), days.cast("int"))
    return F.make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), F.floor(rem / 3600).cast("int"),
                                F.floor((rem % 3600) / 60).cast("int"), (rem % 60).cast("decimal(8,6)"))


def start_date(ts: ColumnOrName) -> Column:
    """The (UTC) date of a timestamp."""
    return F.to_date(_c(ts))


def win_rate(win: ColumnOrName, total: ColumnOrName, digits: int | None = 3) -> Column:
    """round(win / total, 3); zero or NULL total → NULL."""
    r = F.try_divide(_c(win).cast("double"), _c(total).cast("double"))
    return r if digits is None else F.round(r, digits)


def grade_of_score(score: ColumnOrName) -> Column:
    """clamp(trunc(score / 100) − 10, 0, 13)."""
    g = (_c(score) / 100).cast("long") - 10
    # greatest/least skip NULLs, so a NULL score is guarded explicitly
    return F.when(g.isNotNull(), F.greatest(F.least(g, F.lit(GRADE_MAX)), F.lit(GRADE_MIN))).cast("int")


def equip_addition(strength: ColumnOrName, stone: ColumnOrName) -> Column:
    """Equip strength score + stone score."""
    return _c(strength) + _c(stone)


def winner_of(team1_won: ColumnOrName) -> Column:
    """Team 1 won → 1, otherwise (false or NULL) → 2."""
    return F.when(_c(team1_won), F.lit(1)).otherwise(F.lit(2))


def mean_team_score(team_score: ColumnOrName, team_size: ColumnOrName | int = 3) -> Column:
    """Integer mean of a team score, truncated toward zero like integer
    division (divides by 3 unless a size is given)."""
    size = F.lit(team_size) if isinstance(team_size, int) else _c(team_size)
    return F.when(size == 0, F.lit(None)).otherwise((_c(team_score) / size).cast("long"))


def humanize_count(c: ColumnOrName) -> Column:
    """< 1000 as is; else K/M/B with one truncated decimal (``1234`` → ``1.2K``)."""
    n = _c(c).cast("long")

    def fmt(div: int, suffix: str) -> Column:
        whole = (n / F.lit(div)).cast("long")
        frac = ((n % F.lit(div)) * 10 / F.lit(div)).cast("long")
        return F.concat(whole.cast("string"), F.lit("."), frac.cast("string"), F.lit(suffix))

    return (F.when(n < 1000, n.cast("string"))
            .when(n < 1_000_000, fmt(1000, "K"))
            .when(n < 1_000_000_000, fmt(1_000_000, "M"))
            .otherwise(fmt(1_000_000_000, "B")))


def take(c: ColumnOrName, n: ColumnOrName | int) -> Column:
    """The first n elements (fewer if the array is shorter)."""
    k = F.lit(n) if isinstance(n, int) else _c(n)
    return F.slice(_c(c), F.lit(1), F.greatest(k, F.lit(0)))


def drop(c: ColumnOrName, n: ColumnOrName | int) -> Column:
    """All but the first n elements."""
    k = F.lit(n) if isinstance(n, int) else _c(n)
    return F.slice(_c(c), k + 1, F.greatest(F.size(_c(c)) - k, F.lit(0)))


def zip_shortest(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Pairs (a, b) cut to the shorter array (Spark's arrays_zip pads)."""
    n = F.least(F.size(_c(a)), F.size(_c(b)))
    return F.arrays_zip(F.slice(_c(a), F.lit(1), n).alias("a"), F.slice(_c(b), F.lit(1), n).alias("b"))


def sort_kungfus(c: ColumnOrName) -> Column:
    """Stored class arrays sorted ascending."""
    return F.array_sort(_c(c))


def encode_key(c: ColumnOrName) -> Column:
    """Dictionary key text → canonical text, checked in this order: a
    text starting with ``"`` loses its first and last character, ``:name`` →
    ``name``, integer-like text → the integer, anything else unchanged."""
    s = _c(c)
    as_int = s.try_cast("long")
    return (F.when(s.startswith('"'), s.substr(F.lit(2), F.greatest(F.length(s) - 2, F.lit(0))))
            .when(s.startswith(":"), F.substring(s, 2, 1 << 30))
            .when(as_int.isNotNull(), as_int.cast("string"))
            .otherwise(s))


def decode_key_int(c: ColumnOrName) -> Column:
    """The typed form of an integer-like key (NULL otherwise)."""
    return _c(c).try_cast("int")


def role_ids_of(role_ids: ColumnOrName, roles: ColumnOrName) -> Column:
    """role_ids unless given, from the participants' global ids."""
    return F.coalesce(_c(role_ids), F.transform(_c(roles), lambda r: r["global_id"]))


def diff_date(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Days from b to a."""
    return F.datediff(_c(a), _c(b))


def put_default(c: ColumnOrName, value) -> Column:
    """Value when NULL."""
    return F.coalesce(_c(c), value if isinstance(value, Column) else F.lit(value))


def is_recent(ts: ColumnOrName, n: int, unit: str, as_of: ColumnOrName) -> Column:
    """``as_of − ts ≤ n·unit`` in seconds; NULL → false."""
    secs = n * TIME_UNITS[unit]
    diff = epoch_micros(as_of) - epoch_micros(ts)
    return F.coalesce(diff <= F.lit(secs * 1_000_000), F.lit(False))


def to_json_row(*cols: ColumnOrName) -> Column:
    """A row as JSON text; NULL fields are left out."""
    return F.to_json(F.struct(*(cols or ["*"])))


def flat(c: ColumnOrName, sep: str = ",") -> Column:
    """An array as one text (elements cast to string) for engine-neutral output."""
    return F.array_join(F.transform(_c(c), lambda x: x.cast("string")), sep)
