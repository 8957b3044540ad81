"""The metric layer: metrics by dimensions, filters, cumulative windows and a time spine."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deedwork.functions.values import ratio
from deedwork.specs import Measure, Metric, SemanticModel, Where

REDACTED = "[REDACTED:pii]"


class MetricError(ValueError):
    """A metric request that cannot be answered as asked."""


def condition(w: Where, expr: str | None = None) -> Column:
    """A structured filter as a predicate; NULL does not match."""
    c = F.expr(expr or w.dimension)
    tests = {
        "eq": lambda: c == w.value,
        "neq": lambda: c != w.value,
        "gt": lambda: c > w.value,
        "gte": lambda: c >= w.value,
        "lt": lambda: c < w.value,
        "lte": lambda: c <= w.value,
        "in": lambda: c.isin(*w.value),
        "notIn": lambda: ~c.isin(*w.value),
        "isNull": lambda: c.isNull(),
        "isNotNull": lambda: c.isNotNull(),
    }
    if w.op not in tests:
        raise MetricError(f"{w.op!r} is no filter")
    return F.coalesce(tests[w.op](), F.lit(False))


def _measure(model: SemanticModel, name: str) -> Measure:
    for m in model.measures:
        if m.name == name:
            return m
    raise MetricError(f"no measure {name!r}")


def find_metric(model: SemanticModel, name: str) -> Metric:
    for m in model.metrics:
        if m.name == name:
            return m
    if any(m.name == name for m in model.measures):
        return Metric(name, measure=name)
    raise MetricError(f"no metric or measure {name!r}")


def _where_all(model: SemanticModel, filters: Sequence[Where]) -> Column | None:
    out = None
    for w in filters:
        test = condition(w, model.dimensions.get(w.dimension))
        out = test if out is None else out & test
    return out


def aggregate(model: SemanticModel, name: str, extra: Sequence[Where] = ()) -> Column:
    """A metric or measure as one aggregate Column, its own filters inside."""
    metric = find_metric(model, name)
    if metric.kind == "ratio":
        return ratio(aggregate(model, metric.numerator, metric.where), aggregate(model, metric.denominator, metric.where))
    m = _measure(model, metric.measure)
    test = _where_all(model, [*metric.where, *extra])
    value = F.expr(m.expr) if test is None else F.when(test, F.expr(m.expr))
    if m.agg == "count":
        return F.count(value)
    if m.agg == "count_distinct":
        return F.countDistinct(value)
    if m.agg == "avg":
        return ratio(F.sum(value), F.count(value))
    return {"sum": F.sum, "min": F.min, "max": F.max}[m.agg](value)


def output_name(model: SemanticModel, name: str, dimensions: Sequence[str]) -> str:
    """The metric's own name, or its measure's when a dimension already has that name."""
    if name not in dimensions:
        return name
    measure = find_metric(model, name).measure
    if measure is None or measure in dimensions:
        raise MetricError(f"metric {name!r} collides with the dimensions asked for")
    return measure


def query_metrics(
    df: DataFrame,
    model: SemanticModel,
    metrics: Sequence[str],
    dimensions: Sequence[str] = (),
    filters: Sequence[Where] = (),
    limit: int | None = None,
) -> DataFrame:
    """Metrics by dimensions in one aggregation.

    ``filters`` apply to the rows, a metric's own ``where`` only to itself. Derived metrics are
    expressions over the other metrics' names. With a ``limit``, ``truncated`` says whether groups were left out.
    """
    dims = list(dict.fromkeys(dimensions))
    unknown = [d for d in dims if d not in model.dimensions]
    if unknown:
        raise MetricError(f"no dimension {unknown}")
    rows = df if not filters else df.where(_where_all(model, filters))
    derived = [m for m in metrics if find_metric(model, m).kind == "derived"]
    plain = [m for m in metrics if m not in derived]
    named = {output_name(model, m, dims): aggregate(model, m) for m in plain}
    helpers = {}
    for d in derived:
        for other in [*model.metrics, *model.measures]:
            if getattr(other, "kind", "simple") != "derived" and other.name not in named and names_any(find_metric(model, d).expr, {other.name}):
                helpers[other.name] = aggregate(model, other.name)
    out = rows.groupBy(*[F.expr(model.dimensions[d]).alias(d) for d in dims]).agg(
        *[c.alias(n) for n, c in {**named, **helpers}.items()]
    )
    for d in derived:
        out = out.withColumn(d, F.expr(find_metric(model, d).expr))
    out = out.drop(*helpers)
    if limit is None:
        return out
    # One row past the limit tells whether there were more; the window holds no more than these few rows.
    order = [*[F.desc_nulls_last(n) for n in named], *dims]
    few = out.orderBy(*order).limit(limit + 1)
    whole = Window.partitionBy()
    counted = few.select("*", F.row_number().over(whole.orderBy(*order)).alias("_nth"), (F.count("*").over(whole) > limit).alias("truncated"))
    return counted.where(F.col("_nth") <= limit).drop("_nth")


def daily_metric(df: DataFrame, model: SemanticModel, name: str, dimensions: Sequence[str]) -> DataFrame:
    """The metric's measure per calendar day and dimension: the input of every window below."""
    metric = find_metric(model, name)
    m = _measure(model, metric.measure)
    if m.agg not in ("sum", "count"):
        raise MetricError(f"{name}: only sums and counts accumulate")
    return df.groupBy(
        *[F.expr(model.dimensions[d]).alias(d) for d in dimensions],
        F.to_date(F.expr(model.dimensions[model.time_dimension])).alias("day"),
    ).agg(aggregate(model, name).alias(name))


def cumulative(df: DataFrame, model: SemanticModel, name: str, dimensions: Sequence[str] = ()) -> DataFrame:
    """A trailing window of days, or an accumulation since the start of a grain, per day with data."""
    metric = find_metric(model, name)
    daily = daily_metric(df, model, name, dimensions)
    if metric.grain_to_date:
        start = F.trunc("day", metric.grain_to_date)
        w = Window.partitionBy(*dimensions, start).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    else:
        w = Window.partitionBy(*dimensions).orderBy(F.unix_date("day")).rangeBetween(1 - metric.window_days, 0)
    return daily.withColumn(name, F.sum(name).over(w))


def to_coarser_grain(accumulated: DataFrame, name: str, grain: str, period: str, dimensions: Sequence[str] = ()) -> DataFrame:
    """An accumulated daily metric on a coarser grain: its first, last or average day."""
    value = {
        "first": F.min_by(name, "day"),
        "last": F.max_by(name, "day"),
        "average": ratio(F.sum(name), F.count(name)),
    }[period]
    return accumulated.groupBy(*dimensions, F.trunc("day", grain).alias("period")).agg(value.alias(name))


def on_time_spine(daily: DataFrame, name: str, fill=None) -> DataFrame:
    """Every calendar day between the first and the last, with gaps filled when asked."""
    ends = daily.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    out = spine.join(daily, "day", "left")
    return out if fill is None else out.withColumn(name, F.coalesce(name, F.lit(fill)))


def redact(df: DataFrame, model: SemanticModel, dimensions: Sequence[str], metrics: Sequence[str], pii: set[str]) -> DataFrame:
    """Values that would show a personal column are replaced, whatever the output is called.

    What counts is which columns an expression names, not how it is written: ``substr(email, 1, 20)`` shows as much as ``email``.
    MIN and MAX give a value back, and so does what is derived from them; counts do not.
    """
    out = df
    for d in dimensions:
        if names_any(model.dimensions[d], pii):
            out = out.withColumn(d, F.lit(REDACTED))
    for name in metrics:
        if _shows(model, name, pii):
            out = out.withColumn(name, F.lit(REDACTED))
    return out


def names_any(expression: str, columns: set[str]) -> bool:
    """Whether the expression names one of the columns, text literals aside. Case and back quotes do not matter."""
    words = re.findall(r"\w+", re.sub(r"'(?:[^'\\]|\\.|'')*'", " ", expression).lower())
    return not {c.lower() for c in columns}.isdisjoint(words)


def _shows(model: SemanticModel, name: str, pii: set[str]) -> bool:
    found = find_metric(model, name)
    if found.kind == "derived":
        others = [m.name for m in (*model.metrics, *model.measures) if m.name != name and names_any(found.expr, {m.name})]
        return any(_shows(model, other, pii) for other in others)
    parts = [found.measure, found.numerator, found.denominator]
    measures = [_measure(model, part) for part in parts if part]
    return any(m.agg in ("min", "max") and names_any(m.expr, pii) for m in measures)
