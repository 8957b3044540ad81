"""Signals over a run history, and the roll-up of check results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deedwork.functions.values import ratio


def row_count_anomalies(daily: DataFrame, *, day: str, n: str, sensitivity_pct: int = 50, depth: int = 8) -> DataFrame:
    """Daily counts judged three ways: against a decayed average, the quartile fences, and the day before.

    The decayed average halves the weight per day over the last ``depth`` days; weights are whole
    numbers, so the test is exact. ``daily`` has one row per calendar day.
    """
    w = Window.orderBy(day)
    weight, weighted = F.lit(0), F.lit(0)
    for i in range(1, depth + 1):
        before = F.lag(n, i).over(w)
        weight = weight + F.when(before.isNotNull(), 2 ** (depth - i)).otherwise(0)
        weighted = weighted + F.coalesce(before, F.lit(0)) * (2 ** (depth - i))
    fences = daily.agg(
        F.expr(f"percentile_disc(0.25) WITHIN GROUP (ORDER BY {n})").alias("q1"),
        F.expr(f"percentile_disc(0.75) WITHIN GROUP (ORDER BY {n})").alias("q3"),
    )
    q1, q3 = fences.select("q1").scalar(), fences.select("q3").scalar()
    judged = daily.select(
        day, n, weight.alias("_w"), weighted.alias("_s"), F.lag(n, 1).over(w).alias("before"), q1.alias("_q1"), q3.alias("_q3")
    )
    count, spread = F.col(n), F.col("_q3") - F.col("_q1")
    return judged.select(
        day,
        n,
        ratio(F.col("_s"), F.col("_w")).alias("expected"),
        (100 * F.abs(count * F.col("_w") - F.col("_s")) > sensitivity_pct * F.col("_s")).alias("ewma_anomaly"),
        ((2 * count < 2 * F.col("_q1") - 3 * spread) | (2 * count > 2 * F.col("_q3") + 3 * spread)).alias("iqr_anomaly"),
        F.coalesce(count != F.col("before"), F.lit(False)).alias("exact_anomaly"),
    )


def run_signals(history: DataFrame, *, run: str) -> DataFrame:
    """One row per run and signal raised. ``history``: records, bytes, rejects, cursor, fingerprint per run."""
    w = Window.orderBy(run)

    def before(c: str) -> Column:
        return F.lag(c).over(w)

    records, was = F.col("records"), F.col("_records")
    steps = history.select("*", *[before(c).alias(f"_{c}") for c in ("records", "bytes", "rejects", "cursor", "fingerprint")])
    raised = {
        "record_count_drop": records * 2 < was,
        "record_count_surge": records > was * 2,
        "bytes_per_record_outlier": 50 * F.abs(F.col("bytes") * was - F.col("_bytes") * records) > F.col("_bytes") * records,
        "reject_rate_spike": (F.col("rejects") * was > 2 * F.col("_rejects") * records) & (F.col("rejects") > 0),
        "cursor_stalled": F.col("cursor") <= F.col("_cursor"),
        "schema_fingerprint_changed": F.col("fingerprint") != F.col("_fingerprint"),
    }
    signals = F.array(*[F.when(test, F.lit(name)) for name, test in raised.items()])
    return steps.select(run, F.explode(F.array_compact(signals)).alias("signal"))


def results_rollup(results: DataFrame) -> DataFrame:
    """Pass rates of each product's latest run that tested rules, and the daily trend.

    ``results``: product_id, layer, run_date, rule_id, rule_type, passed. A run with only
    structure checks counts as latest when the product has no other.
    """
    is_rule = F.coalesce(F.col("rule_type") != "structure", F.lit(True))
    last = results.groupBy(F.col("product_id").alias("_p")).agg(
        F.coalesce(F.max(F.when(is_rule, F.col("run_date"))), F.max("run_date")).alias("_last")
    )
    latest = results.join(last, (F.col("product_id") == F.col("_p")) & (F.col("run_date") == F.col("_last")))
    rules = latest.where(is_rule)
    none = F.lit(None).cast("string")

    def report(df: DataFrame, kind: str, product, layer, on) -> DataFrame:
        failing = F.count_if(~F.col("passed"))
        return df.agg(F.count("*").alias("rules"), failing.alias("failing")).select(
            F.lit(kind).alias("report"),
            product.alias("product_id"),
            layer.alias("layer"),
            on.cast("string").alias("run_date"),
            none.alias("rule_id"),
            "rules",
            "failing",
            ratio(F.col("rules") - F.col("failing"), F.col("rules")).alias("pass_rate"),
        )

    product, layer, day = F.col("product_id"), F.col("layer"), F.col("run_date")
    failing = latest.where(~F.col("passed")).select(
        F.lit("failing").alias("report"),
        product,
        layer,
        day.cast("string").alias("run_date"),
        "rule_id",
        F.lit(1).cast("bigint").alias("rules"),
        F.lit(1).cast("bigint").alias("failing"),
        F.lit(0.0).alias("pass_rate"),
    )
    return (
        report(rules.groupBy(), "overall", none, none, none)
        .unionByName(report(rules.groupBy("product_id", "layer", "run_date"), "product", product, layer, day))
        .unionByName(report(results.where(is_rule).groupBy("product_id", "run_date"), "trend", product, none, day))
        .unionByName(failing)
    )
