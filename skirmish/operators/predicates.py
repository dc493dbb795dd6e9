"""Caller-given predicate text, judged on Spark's own parse of it.

The text is parsed by the session's parser and the resulting expression is
walked: every node must be of an allowed kind and every function it calls of
the allowed names. Subqueries, windows, parameters, stars and functions that
call into the JVM or the environment are therefore refused however they are
spelled, and words inside string literals mean nothing.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Kinds of node a predicate over one row may hold.
NODES = frozenset("""
    UnresolvedAttribute UnresolvedExtractValue Literal Cast
    And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual In
    IsNull IsNotNull Like RLike ILike LikeAny LikeAll NotLikeAny NotLikeAll
    Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive
    BitwiseAnd BitwiseOr BitwiseXor BitwiseNot CaseWhen Concat StringLocate
    StringTrim StringTrimLeft StringTrimRight Substring
    UnresolvedFunction LambdaFunction UnresolvedNamedLambdaVariable
""".split())

# Functions of one row and nothing else.
FUNCTIONS = frozenset("""
    abs array array_contains array_max array_min array_size arrays_overlap between cardinality ceil ceiling
    char_length coalesce concat concat_ws contains date date_add date_diff date_sub date_trunc datediff day
    dayofmonth dayofweek element_at endswith exists extract filter floor forall from_json get get_json_object
    greatest hour if ifnull ilike instr isnan isnotnull isnull lcase least left len length like locate lower
    map_contains_key minute mod month named_struct nullif nvl nvl2 pmod position pow quarter regexp_like
    right rlike round second sign size split split_part startswith struct substr substring to_date
    to_timestamp transform trim try_add try_divide try_element_at try_subtract try_to_number typeof ucase
    unix_date upper weekofyear year
""".split())


def _children(node) -> list:
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def refused(spark: SparkSession, text: str) -> list[str]:
    """What in ``text`` a predicate may not hold, in the order met (empty: it
    is allowed). Text that doesn't parse raises Spark's own error."""
    found, todo = [], [spark._jsparkSession.sessionState().sqlParser().parseExpression(text)]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind not in NODES:
            found.append(kind)
        elif kind == "UnresolvedFunction":
            parts = node.nameParts()
            name = ".".join(parts.apply(i) for i in range(parts.size()))
            if name.lower() not in FUNCTIONS or node.filter().isDefined() or node.isDistinct():
                found.append(name)
        todo += reversed(_children(node))
    return found
