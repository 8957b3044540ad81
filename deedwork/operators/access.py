"""Governed reads: row filters, column restrictions, masked landing and its verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedwork.functions import crypto
from deedwork.specs import Restriction, RowFilter


class PolicyError(ValueError):
    """A policy that cannot be applied as written is refused, never skipped."""


def checked_filters(filters: Sequence[RowFilter], columns: Sequence[str]) -> dict[str, str]:
    """One filter per principal, each with a principal and a predicate."""
    out: dict[str, str] = {}
    for i, f in enumerate(filters):
        principal, where = (f.principal or "").strip(), (f.where or "").strip()
        if not principal:
            raise PolicyError(f"row filter {i} names no principal")
        if not where:
            raise PolicyError(f"row filter {i} has no predicate")
        if principal in out:
            raise PolicyError(f"{principal} has two row filters: join them with AND")
        out[principal] = where
    return out


def filtered_rows(df: DataFrame, filters: Sequence[RowFilter], principal: str | None) -> DataFrame:
    """The rows ``principal`` may read. Apply it where the table is read, before any other step.

    With filters declared, a reader without an identity is refused.
    """
    rules = checked_filters(filters, df.columns)
    if not rules:
        return df
    if not principal:
        raise PolicyError("the table has row filters and the reader has no principal")
    if principal not in rules:
        return df
    return df.where(F.coalesce(F.expr(rules[principal]), F.lit(False)))


def column_verdicts(columns: Sequence[str], restrictions: Sequence[Restriction], principal: str) -> dict[str, str]:
    """Per column: ``read``, ``deny`` or a masking rule. Deny beats mask, mask beats allow."""
    known = set(columns)
    out = {}
    for r in restrictions:
        if r.access not in ("allow", "deny", "mask"):
            raise PolicyError(f"{r.access!r} is no access")
        missing = [c for c in r.columns if c not in known]
        if missing:
            raise PolicyError(f"the table has no {missing}")
    for c in columns:
        here = [r for r in restrictions if c in r.columns]
        mine = [r for r in here if r.principal in (principal, "*")]
        masks = sorted({r.mask for r in mine if r.access == "mask"})
        allowed = [r for r in here if r.access == "allow"]
        if any(r.access == "deny" for r in mine):
            out[c] = "deny"
        elif masks:
            if len(masks) > 1:
                raise PolicyError(f"{c} has two masking rules")
            out[c] = masks[0]
        elif allowed and not any(r in mine for r in allowed):
            out[c] = "deny"
        else:
            out[c] = "read"
    return out


def readable_columns(df: DataFrame, restrictions: Sequence[Restriction], principal: str) -> DataFrame:
    """The projection a principal reads: denied columns are gone, masked ones come masked."""
    out = []
    for c, verdict in column_verdicts(df.columns, restrictions, principal).items():
        if verdict == "read":
            out.append(F.col(c))
        elif verdict != "deny":
            out.append(crypto.masked_for_reader(F.col(c), verdict).alias(c))
    return df.select(*out)


def governed(
    df: DataFrame, *, principal: str | None, filters: Sequence[RowFilter] = (), restrictions: Sequence[Restriction] = ()
) -> DataFrame:
    """The view a principal queries: rows first, then columns."""
    return readable_columns(filtered_rows(df, filters, principal), restrictions, principal or "")


def treat(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The table with the named columns replaced by their treated form; NULL stays NULL."""
    unknown = [c for c in rules if c not in df.columns]
    if unknown:
        raise PolicyError(f"the table has no {unknown}")
    return df.select(*[rules[c].alias(c) if c in rules else F.col(c) for c in df.columns])


def untreated(df: DataFrame, shapes: dict[str, str]) -> DataFrame:
    """Per treated column: non-null values, and those without the whole-value shape. One pass."""
    totals = df.agg(
        *[F.count(c).alias(f"n_{c}") for c in shapes],
        *[
            F.count_if(F.col(c).isNotNull() & ~crypto.has_shape(F.col(c), shape)).alias(f"bad_{c}")
            for c, shape in shapes.items()
        ],
    )
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("known"), F.col(f"bad_{c}").alias("untreated"))
        for c in shapes
    ]
    return totals.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
