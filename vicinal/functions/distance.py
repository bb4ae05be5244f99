"""Distance functions as Catalyst expressions.

Vectors are ``array<float>`` (any numeric array is cast). All three functions are null when
either vector is null, fail when the lengths differ or an element is null, accumulate in
double, and return a float; ``distance`` returns the unrounded double that ranking uses.
Empty vectors have L2 and Manhattan distance 0; cosine is NaN when a norm is zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.errors import DIFFERENT_DIMENSIONS

METRICS = ("l2", "cosine", "manhattan")


def vector(value: Column | Sequence[float] | None, nesting: int = 1) -> Column:
    """A vector expression; nested arrays of the given depth are flattened, as their items count."""
    if value is None:
        return F.lit(None).cast("array<float>")
    column = value if isinstance(value, Column) else F.array(*[F.lit(float(x)) for x in value])
    for _ in range(nesting - 1):
        column = F.flatten(column)
    return column.cast("array<float>")


def vector_column(df: DataFrame, name: str) -> Column:
    """The named column as a flat vector, whatever its depth of nesting."""
    depth, kind = 0, df.schema[name].dataType
    while isinstance(kind, T.ArrayType):
        depth, kind = depth + 1, kind.elementType
    if not depth or not isinstance(kind, T.NumericType):
        raise TypeError(f"{name} is no numeric array")
    return vector(df[name], depth)


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0).cast("double"), lambda total, x: total + x)


def _terms(a: Column, b: Column, term) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))))


def _guarded(a: Column, b: Column, value: Column) -> Column:
    mismatch = F.raise_error(F.format_string(DIFFERENT_DIMENSIONS, F.size(a), F.size(b))).cast("double")
    hole = F.raise_error(F.lit("a vector has a null element")).cast("double")
    has_null = lambda v: F.exists(v, lambda x: x.isNull())
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(F.size(a) != F.size(b), mismatch)
        .when(has_null(a) | has_null(b), hole)
        .otherwise(value)
    )


def distance(metric: str, a: Column | Sequence[float], b: Column | Sequence[float]) -> Column:
    """Distance in double precision under a metric of ``METRICS``."""
    a, b = vector(a), vector(b)
    if metric == "l2":
        value = F.sqrt(_terms(a, b, lambda x, y: (x - y) * (x - y)))
    elif metric == "manhattan":
        value = _terms(a, b, lambda x, y: F.abs(x - y))
    elif metric == "cosine":
        norms = F.sqrt(_terms(a, a, lambda x, y: x * y)) * F.sqrt(_terms(b, b, lambda x, y: x * y))
        value = F.when(norms == 0, F.lit(float("nan"))).otherwise(1 - _terms(a, b, lambda x, y: x * y) / norms)
    else:
        raise ValueError(f"unknown metric {metric!r}; use one of {', '.join(METRICS)}")
    return _guarded(a, b, value)


def l2_distance(a, b) -> Column:
    """Euclidean distance (the root is taken)."""
    return distance("l2", a, b).cast("float")


def cosine_distance(a, b) -> Column:
    """One minus the cosine similarity, from 0 to 2."""
    return distance("cosine", a, b).cast("float")


def manhattan_distance(a, b) -> Column:
    """Sum of absolute differences."""
    return distance("manhattan", a, b).cast("float")


def sql_expression(metric: str, a: str, b: str) -> str:
    """The float distance of two SQL expressions of type ``array<float>``, as SQL text."""
    total = "0D, (s_, x_) -> s_ + x_"
    norm = lambda v: f"sqrt(aggregate({v}, 0D, (s_, x_) -> s_ + double(x_) * x_))"
    if metric == "l2":
        body = f"sqrt(aggregate(zip_with({a}, {b}, (x_, y_) -> (double(x_) - y_) * (double(x_) - y_)), {total}))"
    elif metric == "manhattan":
        body = f"aggregate(zip_with({a}, {b}, (x_, y_) -> abs(double(x_) - y_)), {total})"
    else:
        norms = f"{norm(a)} * {norm(b)}"
        dot = f"aggregate(zip_with({a}, {b}, (x_, y_) -> double(x_) * y_), {total})"
        body = f"if({norms} = 0, double('NaN'), 1 - {dot} / nullif({norms}, 0D))"
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL"
        f" WHEN size({a}) <> size({b}) THEN float(raise_error(format_string('{DIFFERENT_DIMENSIONS}', size({a}), size({b}))))"
        f" WHEN exists({a}, x_ -> x_ IS NULL) OR exists({b}, x_ -> x_ IS NULL)"
        f" THEN float(raise_error('a vector has a null element')) ELSE float({body}) END"
    )


def register(spark: SparkSession) -> None:
    """Make ``l2_distance``, ``cosine_distance`` and ``manhattan_distance`` SQL functions of the session.

    Spark takes them in SELECT, WHERE, GROUP BY and JOIN; in ORDER BY name their output column.
    """
    for metric in METRICS:
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {metric}_distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS FLOAT"
            f" RETURN {sql_expression(metric, 'a', 'b')}"
        )
