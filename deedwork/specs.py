"""Small specifications a contract is made of. They hold no data and run nothing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    required: bool = False
    levels: tuple[str, ...] = ()
    low: str | None = None
    high: str | None = None
    placeholders: tuple[str, ...] = ()
    placeholder_prefixes: tuple[str, ...] = ()


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    key: tuple[str, ...] = ()


@dataclass(frozen=True)
class Window:
    """A validity window: ``end`` NULL (or equal to ``open_end``) means still valid."""

    start: str
    end: str | None = None
    open_end: str | None = None
    closed: bool = False


@dataclass(frozen=True)
class Link:
    """A declared many-to-one relationship."""

    name: str
    from_columns: tuple[str, ...]
    to_columns: tuple[str, ...]
    how: str = "left"


@dataclass(frozen=True)
class Band:
    """What a rule tolerates, in violating rows or in percent of the covered rows."""

    operator: str = "mustBe"
    value: float | str | Sequence = 0
    unit: str = "rows"


@dataclass(frozen=True)
class Rule:
    """``check`` must hold where ``when`` does; both are Columns over one table."""

    id: str
    check: Column
    when: Column | None = None
    band: Band = field(default_factory=Band)
    severity: str = "error"


@dataclass(frozen=True)
class Restriction:
    """One column restriction of a principal: deny, allow or mask."""

    principal: str
    columns: tuple[str, ...]
    access: str
    mask: str | None = None


@dataclass(frozen=True)
class RowFilter:
    principal: str
    where: str


@dataclass(frozen=True)
class Measure:
    name: str
    agg: str
    expr: str


@dataclass(frozen=True)
class Where:
    dimension: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Metric:
    """A metric of the semantic layer. ``kind``: simple, derived, ratio or cumulative."""

    name: str
    kind: str = "simple"
    measure: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    expr: str | None = None
    where: tuple[Where, ...] = ()
    window_days: int | None = None
    grain_to_date: str | None = None
    fill_nulls_with: float | None = None


@dataclass(frozen=True)
class SemanticModel:
    dimensions: dict[str, str]
    measures: tuple[Measure, ...]
    metrics: tuple[Metric, ...]
    time_dimension: str | None = None
