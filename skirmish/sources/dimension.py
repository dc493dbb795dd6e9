"""The class ("kungfu") dimension, a fixed 23-row local table.

The dimension is tiny and constant, so it is always joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for the same labels and order).
# Class key → (full name, short label), in the reference's listing order.
CLASS_NAMES = [
    ("xisui", "洗髓", "洗"),
    ("yijin", "易经", "秃"),
    ("zixia", "紫霞", "气"),
    ("taixu", "太虚", "剑"),
    ("huajian", "花间", "花"),
    ("aoxue", "傲血", "策"),
    ("lijing", "离经", "离"),
    ("tielao", "铁牢", "铁"),
    ("yunshang", "云裳", "秀"),
    ("bingxin", "冰心", "冰"),
    ("cangjian", "藏剑", "藏"),
    ("dujing", "毒经", "毒"),
    ("butian", "补天", "补"),
    ("jingyu", "惊羽", "鲸"),
    ("tianluo", "天罗", "螺"),
    ("fenying", "焚影", "明"),
    ("mingzun", "明尊", "喵"),
    ("xiaochen", "笑尘", "丐"),
    ("tiegu", "铁骨", "骨"),
    ("fenshan", "分山", "苍"),
    ("mowen", "莫问", "莫"),
    ("xiangzhi", "相知", "歌"),
    ("beiao", "北傲", "霸"),
]
# Display order of the classes.
CLASS_ORDER = [
    "taixu",
    "zixia", "bingxin", "fenying", "yijin", "huajian", "dujing", "tianluo", "mowen",
    "aoxue", "fenshan", "cangjian", "jingyu", "xiaochen", "beiao",
    "xisui", "tielao", "tiegu", "mingzun",
    "lijing", "yunshang", "butian", "xiangzhi",
]
# Pairs where the first always sorts before the second, whatever the ranks.
CLASS_ORDER_EXCEPTIONS = [("jingyu", "tianluo")]
# Label for an id the dimension does not know (sorted last).
UNKNOWN_LABEL = "?"
# ---------------------------------------------------------------------------

DIM_SCHEMA = T.StructType([
    T.StructField("content", T.StringType(), False),
    T.StructField("kungfu", T.StringType(), False),
    T.StructField("short", T.StringType(), False),
    T.StructField("rank", T.IntegerType(), False),
])


def dimension_rows() -> list[tuple[str, str, str, int]]:
    """(content, kungfu, short, rank) with rank = 1-based display position."""
    rank = {name: i + 1 for i, name in enumerate(CLASS_ORDER)}
    return [(c, k, s, rank[c]) for c, k, s in CLASS_NAMES]


_dims: dict[str, DataFrame] = {}


def class_dimension(spark: SparkSession) -> DataFrame:
    """A4: the dimension as a DataFrame (23 fixed rows, built on the driver
    once per application and reused)."""
    key = spark.sparkContext.applicationId
    if key not in _dims:
        _dims[key] = local_dimension(spark, dimension_rows(), DIM_SCHEMA)
    return _dims[key]


def dimension_values_sql() -> str:
    """The dimension as a SQL VALUES list (for the DuckDB oracle)."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    rows = ", ".join(f"({q(c)}, {q(k)}, {q(s)}, {r})" for c, k, s, r in dimension_rows())
    return f"SELECT * FROM (VALUES {rows}) AS t(content, kungfu, short, rank)"


def local_dimension(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """A4 (general form): a small driver-side table as a DataFrame, with an
    explicit schema (no inference). Meant for fixed dimensions like the class
    table; join it with ``F.broadcast`` — its size is known."""
    return spark.createDataFrame(rows, schema)


def dump_json(df: DataFrame) -> DataFrame:
    """The rows of ``df`` (its argument, Q9) as JSON text, one per row."""
    from pyspark.sql import functions as F

    return df.select(F.to_json(F.struct("*")).alias("value"))
