"""A table beside its declared schema: what is missing, extra, of another type, or null where required."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedwork.specs import TableSpec

# Spellings that mean one type.
TYPE_NAMES = {
    "int": "bigint",
    "integer": "bigint",
    "smallint": "bigint",
    "tinyint": "bigint",
    "long": "bigint",
    "float": "double",
    "real": "double",
    "number": "double",
    "varchar": "string",
    "text": "string",
    "bool": "boolean",
    "datetime": "timestamp",
    "timestamp_ntz": "timestamp",
}


def plain_type(name: str) -> str:
    name = name.lower().strip()
    return TYPE_NAMES.get(name, name)


def conformance_issues(df: DataFrame, spec: TableSpec) -> DataFrame:
    """One row per issue: ``column_name, issue, declared, actual, verdict, affected``.

    ``affected`` counts the rows behind the issue: all rows for a missing column, non-null
    values for an extra one, values the declared type cannot hold for another type, and NULLs for
    a required column. All counts come from one pass.
    """
    actual = {f.name: f for f in df.schema.fields}
    found = []
    for c in spec.columns:
        here = actual.get(c.name)
        if here is None:
            found.append((c.name, "missing", c.type, "none", "structure", F.count("*")))
            continue
        kind = here.dataType.simpleString()
        if plain_type(kind) != plain_type(c.type):
            unfit = F.count_if(F.col(c.name).isNotNull() & F.col(c.name).cast("string").try_cast(plain_type(c.type)).isNull())
            found.append((c.name, "type", c.type, kind, "types", unfit))
        if c.required:
            found.append((c.name, "null_in_required", "required", "nullable", "types", F.count_if(F.col(c.name).isNull())))
    declared = {c.name for c in spec.columns}
    for name, here in actual.items():
        if name not in declared:
            found.append((name, "extra", "none", here.dataType.simpleString(), "structure", F.count(name)))
    totals = df.agg(*[agg.alias(f"a{i}") for i, (*_, agg) in enumerate(found)])
    rows = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(issue).alias("issue"),
            F.lit(declared_as).alias("declared"),
            F.lit(kind).alias("actual"),
            F.lit(verdict).alias("verdict"),
            F.col(f"a{i}").alias("affected"),
        )
        for i, (name, issue, declared_as, kind, verdict, _) in enumerate(found)
    ]
    return (
        totals.select(F.explode(F.array(*rows)).alias("r"))
        .select("r.*")
        .where("issue <> 'null_in_required' OR affected > 0")
    )


def volume(df: DataFrame, name: str, minimum: int) -> DataFrame:
    """Empty and below-minimum verdicts of one table."""
    return df.agg(F.count("*").alias("rows")).select(
        F.lit(name).alias("table_name"),
        "rows",
        F.lit(minimum).cast("bigint").alias("minimum"),
        F.when(F.col("rows") == 0, "empty_table")
        .when(F.col("rows") < minimum, "row_count_below_threshold")
        .otherwise("ok")
        .alias("verdict"),
    )
