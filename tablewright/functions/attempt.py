"""Expressions whose failures are values.

Under ANSI rules a bad cast or a division by zero ends the job. Spark's own ``TryEval``
expression turns such a failure into null inside the JVM. It has no public function
for arbitrary expressions, so the calls into Spark's classic API are kept here.

Two things need care. Spark computes a part that several expressions share once and ahead
of all of them, outside their ``TryEval``; so the tried expression is the branch of a
conditional, whose branches Spark leaves alone, under a condition that is always true but
not to the optimizer. And a tried expression is opaque to the scan; so an expression that
can't fail, by its analysed form, stays as it is, and a condition is split at its ANDs.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Expressions that don't fail if their inputs don't.
SAFE = frozenset(
    "Alias And AttributeReference CaseWhen Coalesce Contains EndsWith EqualNullSafe EqualTo GetStructField GreaterThan GreaterThanOrEqual If In InSet "
    "IsNaN IsNotNull IsNull Length LessThan LessThanOrEqual Literal Lower Not OctetLength Or StartsWith StringTrim StringTrimLeft StringTrimRight TryEval Upper".split()
)
# Arithmetic that doesn't fail on doubles and floats.
SAFE_ON_DOUBLES = frozenset("Abs Add Multiply Subtract UnaryMinus".split())


def _jvm():
    return SparkContext._active_spark_context._jvm


def _catalyst():
    return _jvm().org.apache.spark.sql.catalyst.expressions


def _column(e) -> Column:
    return Column(_jvm().org.apache.spark.sql.classic.ExpressionUtils.column(e))


def _try(c: Column) -> Column:
    utils = _jvm().org.apache.spark.sql.classic.ExpressionUtils
    return _column(_catalyst().TryEval(utils.expression(c._jc)))


def _analysed(df: DataFrame, c: Column):
    """The resolved expression over the columns of ``df``; None if it isn't a plain one (a window, for example)."""
    plan = df.select(c)._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "Project" or plan.projectList().size() != 1:
        return None
    e = plan.projectList().head()
    e = e.child() if e.getClass().getSimpleName() == "Alias" else e
    return e if e.references().subsetOf(df._jdf.queryExecution().analyzed().outputSet()) else None


def _name(e) -> str:
    return e.getClass().getSimpleName()


def _children(e) -> list:
    found = e.children()
    return [found.apply(k) for k in range(found.size())]


def _evaluates(e) -> bool:
    """A constant is computed once, here."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        e.eval(None)
        return True
    except (Py4JJavaError, PySparkException):
        return False


def _never_fails(e) -> bool:
    name = _name(e)
    if name in ("AttributeReference", "Literal", "TryEval"):
        return True
    if e.foldable():
        return _evaluates(e)
    if name == "Cast":
        child = e.child()
        harmless = e.evalMode().toString() == "TRY" or _catalyst().Cast.canUpCast(child.dataType(), e.dataType())
        return harmless and _never_fails(child)
    if name == "Like":  # a pattern without escapes is valid
        pattern = e.right()
        return _name(pattern) == "Literal" and "\\" not in pattern.toString() and e.escapeChar() == "\\" and _never_fails(e.left())
    doubles = name in SAFE_ON_DOUBLES and e.dataType().simpleString() in ("double", "float")
    return (name in SAFE or doubles) and all(map(_never_fails, _children(e)))


def _always(e) -> Column | None:
    """A condition over a column that the expression reads: always true, cheap, and unknown to the optimizer."""
    kinds = {}
    found = e.references().toSeq()
    for k in range(found.size()):
        a = found.apply(k)
        kinds.setdefault(a.dataType().typeName().split("(")[0], a)
    plain = next((a for kind, a in kinds.items() if kind not in ("string", "binary", "array", "map", "struct", "variant")), None)
    if plain is not None:
        mark = F.hash(_column(plain))
    elif "string" in kinds or "binary" in kinds:
        mark = F.octet_length(_column(kinds.get("string") or kinds["binary"]))
    elif "array" in kinds or "map" in kinds:
        mark = F.size(_column(kinds.get("array") or kinds["map"]))
    elif "struct" in kinds:
        mark = F.hash(_column(kinds["struct"]))
    else:
        return None
    return F.coalesce(mark, F.lit(0)).bitwiseAND(F.lit(0)) == 0


def _apart(e) -> Column:
    """The tried expression, kept out of what expressions share."""
    always = _always(e)
    return _try(_column(e) if always is None else F.when(always, _column(e)))


def can_fail(df: DataFrame, c: Column) -> bool:
    e = _analysed(df, c)
    return e is None or not _never_fails(e)


def attempt(df: DataFrame, c: Column) -> Column:
    """The value over the columns of ``df``, or null in the rows where evaluating it fails."""
    e = _analysed(df, c)
    if e is None:
        return _try(c)
    return _column(e) if _never_fails(e) else _apart(e)


def attempt_struct(df: DataFrame, c: Column) -> Column:
    """A struct with the value as ``v``, or null where evaluating it fails: a null value isn't a failure."""
    e = _analysed(df, c)
    if e is None:
        return _try(F.struct(c.alias("v")))
    always = _always(e)
    made = F.struct(_column(e).alias("v"))
    return made if _never_fails(e) else _try(made if always is None else F.when(always, made))


def attempt_condition(df: DataFrame, c: Column) -> Column:
    """A filter's condition: its ANDs apart, so that those which can't fail reach the scan."""
    e = _analysed(df, c)
    if e is None:
        return _try(c)
    parts, safe, rest = [e], [], []
    while parts:
        part = parts.pop()
        if _name(part) == "And":
            parts += [part.right(), part.left()]
        else:
            (safe if _never_fails(part) else rest).append(part)
    out = None
    for part in [*map(_column, safe), *map(_apart, rest)]:
        out = part if out is None else out & part
    return out


def regex_groups(pattern: str) -> int | None:
    """Number of groups of a Java regular expression, or None if it isn't one."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        return _jvm().java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except (Py4JJavaError, PySparkException):
        return None
