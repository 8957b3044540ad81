"""Data-quality checks: one row per check, all checks of a table in one aggregate pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedwork.functions.durations import seconds_of
from deedwork.functions.rules import truth
from deedwork.functions.values import ratio
from deedwork.specs import Band, Rule

RESULT = ("rule_id", "type", "covered", "violating", "actual", "expected", "passed", "severity")


@dataclass(frozen=True)
class Check:
    """``aggs`` are read in the one pass; ``outcome`` turns them into the result row."""

    id: str
    type: str
    aggs: dict[str, Column]
    outcome: Callable[[dict[str, Column]], dict[str, Column]]
    severity: str = "error"


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Every check over ``df``: a single aggregation, then one result row per check."""
    named = {}
    for i, check in enumerate(checks):
        for key, agg in check.aggs.items():
            named[f"c{i}_{key}"] = agg
    totals = df.agg(*[agg.alias(name) for name, agg in named.items()])
    rows = []
    for i, check in enumerate(checks):
        found = check.outcome({key: F.col(f"c{i}_{key}") for key in check.aggs})
        rows.append(
            F.struct(
                F.lit(check.id).alias("rule_id"),
                F.lit(check.type).alias("type"),
                found["covered"].cast("bigint").alias("covered"),
                found["violating"].cast("bigint").alias("violating"),
                found["actual"].cast("double").alias("actual"),
                F.lit(found["expected"]).alias("expected"),
                truth(found["passed"]).alias("passed"),
                F.lit(check.severity).alias("severity"),
            )
        )
    return totals.select(F.explode(F.array(*rows)).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in RESULT])


_COMPARE = {
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def _least(cols: Sequence[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.least(*cols)


def _greatest(cols: Sequence[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def completeness(id: str, columns: Sequence[str], threshold: float = 1.0, op: str = ">=", severity: str = "error") -> Check:
    """The lowest non-null ratio of the columns decides; an empty table has ratio 0."""
    aggs = {"rows": F.count("*"), **{f"n_{c}": F.count(c) for c in columns}}

    def outcome(a):
        lowest = _least([a[f"n_{c}"] for c in columns])
        actual = F.coalesce(ratio(lowest, a["rows"]), F.lit(0.0))
        return {
            "covered": a["rows"],
            "violating": a["rows"] - lowest,
            "actual": actual,
            "expected": f"{op} {threshold}",
            "passed": _COMPARE[op](actual, F.lit(threshold)),
        }

    return Check(id, "completeness", aggs, outcome, severity)


def _violations(id: str, type_: str, tests: dict[str, Column], expected: str, severity: str) -> Check:
    """``tests``: per column, what must hold of a non-null value."""
    aggs = {}
    for c, holds in tests.items():
        aggs[f"n_{c}"] = F.count(c)
        aggs[f"bad_{c}"] = F.count_if(F.col(c).isNotNull() & ~truth(holds))

    def outcome(a):
        bad = reduce(lambda x, y: x + y, [a[f"bad_{c}"] for c in tests])
        return {
            "covered": reduce(lambda x, y: x + y, [a[f"n_{c}"] for c in tests]),
            "violating": bad,
            "actual": bad,
            "expected": expected,
            "passed": bad == 0,
        }

    return Check(id, type_, aggs, outcome, severity)


def valid_values(id: str, domains: dict[str, Sequence], severity: str = "error") -> Check:
    """Each column on its own domain."""
    tests = {c: F.col(c).isin(*values) for c, values in domains.items()}
    return _violations(id, "valid_values", tests, "0 values outside the list", severity)


def pattern(id: str, column: str, regex: str, severity: str = "error") -> Check:
    return _violations(id, "pattern", {column: F.col(column).rlike(regex)}, f"0 values not matching {regex}", severity)


def value_range(id: str, column: str, low=None, high=None, severity: str = "error") -> Check:
    c = F.col(column)
    test = F.lit(True)
    if low is not None:
        test = test & (c >= low)
    if high is not None:
        test = test & (c <= high)
    return _violations(id, "range", {column: test}, f"between {low} and {high}", severity)


def bound(id: str, columns: Sequence[str], op: str, threshold: float, severity: str = "error") -> Check:
    """``>=``/``>`` judge the smallest value, ``<=``/``<`` the largest, ``==``/``!=`` count rows.

    A column without data fails.
    """
    aggs = {f"n_{c}": F.count(c) for c in columns}
    # A whole number or decimal text stays exact, so long and decimal columns are not judged in floating point.
    limit = F.lit(threshold) if isinstance(threshold, (int, float)) else F.lit(Decimal(str(threshold)))
    for c in columns:
        col = F.col(c)
        aggs[f"bad_{c}"] = F.count_if(~_COMPARE[op](col, limit))
        if op in (">=", ">"):
            aggs[f"end_{c}"] = F.min(col)
        elif op in ("<=", "<"):
            aggs[f"end_{c}"] = F.max(col)

    def outcome(a):
        bad = reduce(lambda x, y: x + y, [a[f"bad_{c}"] for c in columns])
        if op in ("==", "!="):
            actual, passed = bad, bad == 0
        else:
            ends = [a[f"end_{c}"] for c in columns]
            actual = _least(ends) if op in (">=", ">") else _greatest(ends)
            passed = reduce(lambda x, y: x & y, [truth(_COMPARE[op](e, limit)) for e in ends])
        some = reduce(lambda x, y: x & y, [a[f"n_{c}"] > 0 for c in columns])
        return {
            "covered": reduce(lambda x, y: x + y, [a[f"n_{c}"] for c in columns]),
            "violating": bad,
            "actual": actual,
            "expected": f"{op} {threshold}",
            "passed": passed & some,
        }

    return Check(id, "accuracy", aggs, outcome, severity)


def freshness(id: str, column: str, reference: str, window: str, severity: str = "error") -> Check:
    """Seconds from the newest value to ``reference`` (given, so a rerun gives the same answer)."""
    limit = seconds_of(window)

    def outcome(a):
        now = F.lit(reference).cast("timestamp_ntz")
        age = F.timestamp_diff("SECOND", a["newest"], now)
        return {
            "covered": a["rows"],
            "violating": F.when(truth(age <= limit), 0).otherwise(1),
            "actual": age,
            "expected": f"<= {limit} s",
            "passed": age <= limit,
        }

    aggs = {"newest": F.max(F.col(column).cast("timestamp_ntz")), "rows": F.count(column)}
    return Check(id, "freshness", aggs, outcome, severity)


def in_band(covered: Column, violating: Column, band: Band) -> Column:
    """Whether the counts meet the band, compared exactly: percent as 100·violating to value·covered."""
    values = list(band.value) if isinstance(band.value, (list, tuple)) else [band.value]
    limits = [F.lit(str(v)).cast("decimal(20,6)") for v in values]

    def met(left: Column, scale: Column | None) -> Column:
        ends = [x if scale is None else x * scale.cast("decimal(18,0)") for x in limits]
        a = left.cast("decimal(20,0)")
        return {
            "mustBe": lambda: a == ends[0],
            "mustNotBe": lambda: a != ends[0],
            "mustBeLessThan": lambda: a < ends[0],
            "mustBeLessOrEqualTo": lambda: a <= ends[0],
            "mustBeGreaterThan": lambda: a > ends[0],
            "mustBeGreaterOrEqualTo": lambda: a >= ends[0],
            "mustBeBetween": lambda: (a >= ends[0]) & (a <= ends[1]),
        }[band.operator]()

    if band.unit != "percent":
        return met(violating, None)
    return F.when(covered == 0, met(F.lit(0), None)).otherwise(met(violating * 100, covered))


def invariant(rule: Rule, type_: str = "invariant") -> Check:
    """Counts the rows ``when`` covers and those of them ``check`` does not hold for."""
    covered = F.lit(True) if rule.when is None else truth(rule.when)
    aggs = {"covered": F.count_if(covered), "violating": F.count_if(covered & ~truth(rule.check))}
    unit = "%" if rule.band.unit == "percent" else "rows"

    def outcome(a):
        share = ratio(a["violating"] * 100, a["covered"])
        return {
            "covered": a["covered"],
            "violating": a["violating"],
            "actual": F.coalesce(share, F.lit(0.0)) if unit == "%" else a["violating"],
            "expected": f"{rule.band.operator} {rule.band.value} {unit}",
            "passed": in_band(a["covered"], a["violating"], rule.band),
        }

    return Check(rule.id, type_, aggs, outcome, rule.severity)


def result_row(df: DataFrame, id: str, type_: str, expected: str, severity: str = "error") -> DataFrame:
    """A result row from a one-row ``covered, violating`` frame; any violation fails."""
    return df.select(
        F.lit(id).alias("rule_id"),
        F.lit(type_).alias("type"),
        F.coalesce(F.col("covered"), F.lit(0)).cast("bigint").alias("covered"),
        F.coalesce(F.col("violating"), F.lit(0)).cast("bigint").alias("violating"),
        F.coalesce(F.col("violating"), F.lit(0)).cast("double").alias("actual"),
        F.lit(expected).alias("expected"),
        (F.coalesce(F.col("violating"), F.lit(0)) == 0).alias("passed"),
        F.lit(severity).alias("severity"),
    )


def uniqueness(df: DataFrame, id: str, column: str, severity: str = "error") -> DataFrame:
    """Rows beyond the first of each non-null value, counted per value before anything else."""
    per_value = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    counts = per_value.agg(F.sum("n").alias("covered"), F.sum(F.col("n") - 1).alias("violating"))
    return result_row(counts, id, "uniqueness", "0 repeated", severity)


def dependency(df: DataFrame, id: str, source: Sequence[str], target: str) -> DataFrame:
    """``source`` determines ``target``: a source value with two known targets breaks the rule."""
    known = df.dropna(subset=list(source)).where(F.col(target).isNotNull())
    per = known.groupBy(*source).agg(
        F.count("*").alias("n"), (F.min(target) != F.max(target)).cast("int").alias("broken")
    )
    counts = per.agg(F.sum("n").alias("covered"), F.sum(F.col("n") * F.col("broken")).alias("violating"))
    return result_row(counts, id, "dependency", "one target per source")


@dataclass(frozen=True)
class Gate:
    """A row gate: ``not_null``, ``regex`` (from the start of the text) or ``range``."""

    id: str
    rule: str
    columns: tuple[str, ...]
    pattern: str | None = None
    low: float | None = None
    high: float | None = None
    severity: str = "error"

    def passes(self) -> Column:
        first = F.col(self.columns[0])
        if self.rule == "not_null":
            return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in self.columns])
        if self.rule == "regex":
            return first.isNull() | first.cast("string").rlike(f"^(?:{self.pattern})")
        number = first.cast("string").try_cast("double")
        inside = number.isNotNull()
        if self.low is not None:
            inside = inside & (number >= self.low)
        if self.high is not None:
            inside = inside & (number <= self.high)
        return first.isNull() | truth(inside)


def gate_rows(df: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """Every row with ``outcome`` (passed, warned, rejected), ``reason`` and ``warnings``.

    Gates run in order up to the first failing error gate, which rejects the row. Failing warn
    gates before it are counted. Split the result on ``outcome`` for the two outputs.
    """
    reason = F.lit(None).cast("string")
    for g in reversed([g for g in gates if g.severity == "error"]):
        reason = F.when(~g.passes(), F.lit(g.id)).otherwise(reason)
    order = {g.id: i for i, g in enumerate(gates)}
    stop = F.lit(len(gates))
    for g in gates:
        if g.severity == "error":
            stop = F.when(F.col("reason") == g.id, F.lit(order[g.id])).otherwise(stop)
    warned = [
        ((~g.passes()) & (F.lit(order[g.id]) < stop)).cast("int") for g in gates if g.severity != "error"
    ]
    warnings = reduce(lambda a, b: a + b, warned) if warned else F.lit(0)
    return (
        df.withColumn("reason", reason)
        .withColumn("warnings", warnings)
        .withColumn(
            "outcome",
            F.when(F.col("reason").isNotNull(), "rejected").when(F.col("warnings") > 0, "warned").otherwise("passed"),
        )
    )
