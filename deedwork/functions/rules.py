"""Rule expressions: two-valued truth and exact numbers, as plain Columns.

SQL gives three truth values; a rule about valid data has two. A comparison with NULL is FALSE,
and so is a NULL predicate, so every helper returns TRUE or FALSE and ``negate`` is a real opposite.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _col(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def truth(c: Column) -> Column:
    """A predicate where TRUE or FALSE is expected: NULL counts as FALSE."""
    return F.coalesce(c, F.lit(False))


def compare(left, op: str, right) -> Column:
    a, b = _col(left), _col(right)
    tests = {
        "=": lambda: a == b,
        "<>": lambda: a != b,
        "<": lambda: a < b,
        "<=": lambda: a <= b,
        ">": lambda: a > b,
        ">=": lambda: a >= b,
    }
    return truth(tests[op]())


def one_of(x: Column, items, negated: bool = False) -> Column:
    """``x [NOT] IN (items)``; a NULL ``x`` is FALSE either way, a NULL item matches nothing."""
    known = [i for i in items if i is not None]
    found = x.isin(*known) if known else F.lit(False)
    return truth(x.isNotNull() & ~found) if negated else truth(found)


def between(x: Column, low, high, negated: bool = False) -> Column:
    """Both bounds included; the negation is its own two comparisons."""
    if negated:
        return compare(x, "<", low) | compare(x, ">", high)
    return compare(x, ">=", low) & compare(x, "<=", high)


def distinct_from(left, right, negated: bool = False) -> Column:
    same = _col(left).eqNullSafe(_col(right))
    return same if negated else ~same


def both(*tests: Column) -> Column:
    out = truth(tests[0])
    for t in tests[1:]:
        out = out & truth(t)
    return out


def either(*tests: Column) -> Column:
    out = truth(tests[0])
    for t in tests[1:]:
        out = out | truth(t)
    return out


def negate(test: Column) -> Column:
    return ~truth(test)


def choose(cases: list[tuple[Column, object]], otherwise=None) -> Column:
    """CASE whose tests count NULL as FALSE."""
    out = None
    for test, value in cases:
        out = F.when(truth(test), _col(value)) if out is None else out.when(truth(test), _col(value))
    return out if otherwise is None else out.otherwise(_col(otherwise))


def exact(c: Column, scale: int) -> Column:
    """``c`` as DECIMAL(38, scale), the common type two operands meet in. Overflow raises (ANSI)."""
    return c.cast(f"decimal(38,{scale})")


def common(scale: int, *cols: Column) -> list[Column]:
    return [exact(c, scale) for c in cols]


def divide(top: Column, bottom: Column) -> Column:
    """Decimal division; over zero it is NULL."""
    return F.try_divide(top, bottom)


def round_away(c: Column, places: int) -> Column:
    """Ties go away from zero. ``c`` must be a decimal."""
    return F.round(c, places)


def round_even(c: Column, places: int) -> Column:
    """Ties go to the even neighbour. ``c`` must be a decimal."""
    return F.bround(c, places)


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def _forward_months(a: Column, b: Column) -> Column:
    """Whole months from ``a`` to a later ``b``.

    A month is complete on the start's day of the month, or on the last day of a shorter month.
    """
    calendar = (F.year(b) - F.year(a)) * 12 + (F.month(b) - F.month(a))
    unfinished = (F.dayofmonth(a) > F.dayofmonth(b)) & (b != F.last_day(b))
    return calendar - unfinished.cast("int")


def months_between(start: Column, end: Column) -> Column:
    return F.when(end >= start, _forward_months(start, end)).when(end < start, -_forward_months(end, start))


def years_between(start: Column, end: Column) -> Column:
    """Whole months over twelve, toward zero."""
    return (months_between(start, end) / 12).cast("int")


# Days of 0001-01-01 and 9999-12-31 counted from 1970-01-01.
FIRST_DAY, LAST_DAY = -719162, 2932896


def add_days(date: Column, n: Column) -> Column:
    at = F.unix_date(date)
    steps = F.when(n.between(F.lit(FIRST_DAY) - at, F.lit(LAST_DAY) - at), n).cast("int")
    return F.date_add(date, steps)


def add_months(date: Column, n: Column) -> Column:
    """Keeps the day of the month or falls back to a shorter month's last day; NULL out of range."""
    index = F.year(date) * 12 + F.month(date) - 1
    steps = F.when(n.between(F.lit(12) - index, F.lit(119999) - index), n).cast("int")
    return F.add_months(date, steps)


def add_years(date: Column, n: Column) -> Column:
    """Twelve months a year. The count is bounded first, so that times twelve cannot overflow."""
    steps = F.when(n.between(F.lit(1) - F.year(date), F.lit(9999) - F.year(date)), n).cast("int")
    return F.add_months(date, steps * 12)
