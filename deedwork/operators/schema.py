"""Schemas as data: fingerprints, differences, evolution applied to rows, reader compatibility."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The numeric ladder, narrow to wide.
LADDER = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")

# Spellings of one physical type.
FAMILIES = (
    ("double", "numeric", "hugeint", "uhugeint", "int128", "uint128", "bignum", "varint", "ubigint", "uint64"),
    ("bigint", "uinteger", "uint32", "oid"),
    ("int", "integer", "integral", "signed", "usmallint", "uint16"),
    ("smallint", "utinyint", "uint8", "short"),
    ("tinyint", "int1"),
    ("string", "varchar", "text", "char", "bpchar", "nvarchar", "null"),
    ("boolean", "bool", "logical"),
    ("timestamp", "timestamp_ntz", "timestamp_ltz", "timestamptz", "timestamp_tz", "timestamp with time zone", "datetime")
    + ("timestamp_s", "timestamp_ms", "timestamp_us", "timestamp_ns"),
    ("time", "timetz", "time_ns", "time with time zone"),
    ("binary", "bytes", "blob"),
    ("bit", "bitstring"),
    ("array", "list"),
    ("struct", "tuple"),
)

POLICIES = ("strict", "discover_and_freeze", "evolve_safe", "evolve_all")

# What a policy does about each event.
ACTIONS = {
    "strict": {"added": "fail", "removed": "fail", "type_widened": "fail", "type_narrowed": "fail", "type_changed": "fail"},
    "discover_and_freeze": {
        "added": "fail",
        "removed": "fail",
        "type_widened": "fail",
        "type_narrowed": "fail",
        "type_changed": "fail",
    },
    "evolve_safe": {"added": "include", "removed": "warn", "type_widened": "OK", "type_narrowed": "fail", "type_changed": "fail"},
    "evolve_all": {"added": "include", "removed": "drop", "type_widened": "OK", "type_narrowed": "cast", "type_changed": "cast"},
}
STRICTNESS = {"OK": 0, "include": 0, "drop": 0, "cast": 0, "warn": 1, "fail": 2}


def field_table(df: DataFrame) -> DataFrame:
    """One row per column: ``name, type, known`` (non-null values) and ``nulls``, from one pass."""
    fields = df.schema.fields
    totals = df.agg(F.count("*").alias("n"), *[F.count(f"`{f.name}`").alias(f"k{i}") for i, f in enumerate(fields)])
    rows = [
        F.struct(
            F.lit(f.name).alias("name"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f"k{i}").alias("known"),
            (F.col("n") - F.col(f"k{i}")).alias("nulls"),
        )
        for i, f in enumerate(fields)
    ]
    return totals.select(F.explode(F.array(*rows)).alias("f")).select("f.*")


def fingerprint(fields: DataFrame) -> DataFrame:
    """The order-insensitive sha256 of name, type and observed nullability."""
    one = F.concat(
        F.lit('{"name": "'),
        F.col("name"),
        F.lit('", "nullable": '),
        (F.col("nulls") > 0).cast("string"),
        F.lit(', "type": "'),
        F.col("type"),
        F.lit('"}'),
    )
    listed = fields.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("name", one.alias("text")))), lambda x: x["text"]).alias("all"),
        F.count("*").alias("columns"),
    )
    text = F.concat(F.lit("["), F.array_join("all", ", "), F.lit("]"))
    return listed.select(F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("digest"), "columns")


def _base(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\(.*\)$", ""), r"\([0-9]+\) with time zone$", " with time zone")


def _rung(c: Column) -> Column:
    """Position on the numeric ladder, counted from 1; 0 off the ladder."""
    spelled = F.when(_base(c) == "integer", "int").otherwise(_base(c))
    return F.array_position(F.array(*[F.lit(x) for x in LADDER]), spelled)


def _family(c: Column) -> Column:
    """The first spelling of the type's family; a container keeps what it holds, which is part of the type."""
    out = F.regexp_replace(F.regexp_replace(_base(c), "^list<", "array<"), "^tuple<", "struct<")
    for names in FAMILIES:
        out = F.when(_base(c).isin(*names), names[0]).otherwise(out)
    return out


def schema_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """``event, name, before, after, affected`` of two field tables.

    ``affected`` counts the known values behind the event.
    """
    old = baseline.select("name", F.col("type").alias("before"), F.col("known").alias("_old"))
    new = current.select("name", F.col("type").alias("after"), F.col("known").alias("_new"))
    a, b = F.col("before"), F.col("after")
    on_ladder = (_rung(a) > 0) & (_rung(b) > 0)
    event = (
        F.when(a.isNull(), "added")
        .when(b.isNull(), "removed")
        .when(F.lower(a) == F.lower(b), None)
        .when(on_ladder & (_rung(a) < _rung(b)), "type_widened")
        .when(on_ladder & (_rung(a) > _rung(b)), "type_narrowed")
        .when((_base(a) == "decimal") & (_base(b) == "decimal"), "type_changed")
        .when(_family(a) == _family(b), None)
        .otherwise("type_changed")
    )
    return (
        old.join(new, "name", "full")
        .select(event.alias("event"), "name", "before", "after", F.coalesce("_new", "_old").alias("affected"))
        .where("event IS NOT NULL")
    )


def resolve_action(policy: str, event: str, override: str | None = None, first_run: bool = False) -> str:
    """The action for an event. An override can only tighten the policy."""
    action = ACTIONS[policy][event]
    if policy == "discover_and_freeze" and event == "added" and first_run:
        action = "include"
    if override in STRICTNESS and STRICTNESS[override] > STRICTNESS[action]:
        return override
    return action


def decisions(diff: DataFrame, policy: str, overrides: dict[str, str] | None = None, first_run: bool = False) -> DataFrame:
    """``diff`` with the action of each event."""
    overrides = overrides or {}
    action = F.lit(None).cast("string")
    for event in ACTIONS[policy]:
        asked = {"added": "onAddedColumn", "removed": "onRemovedColumn"}.get(event, "onTypeChange")
        chosen = resolve_action(policy, event, overrides.get(asked), first_run)
        action = F.when(F.col("event") == event, F.lit(chosen)).otherwise(action)
    return diff.withColumn("action", action)


class SchemaDrift(ValueError):
    """The policy refuses the new schema."""


def evolve(df: DataFrame, baseline: T.StructType, policy: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """``df`` brought to the evolved schema, with ``rejected``: the column whose cast failed, else NULL.

    Added columns are kept when included, removed ones come back as NULL (or go when dropped), a
    changed type is cast to the baseline's, and a value the cast loses sends its row to the rejects.
    """
    overrides = overrides or {}
    old = {f.name: f.dataType.simpleString() for f in baseline.fields}
    new = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    columns, casts, refused = [], {}, []
    for name in [*old, *[n for n in new if n not in old]]:
        event = change_of(old.get(name), new.get(name))
        if event is None:
            columns.append(F.col(name))
            continue
        key = {"added": "onAddedColumn", "removed": "onRemovedColumn"}.get(event, "onTypeChange")
        action = resolve_action(policy, event, overrides.get(key))
        if action == "fail":
            refused.append(f"{name}: {event}")
        elif event == "removed":
            if action != "drop":
                columns.append(F.lit(None).cast(old[name]).alias(name))
        elif action == "cast":
            casts[name] = F.col(name).try_cast(old[name])
            columns.append(casts[name].alias(name))
        else:
            columns.append(F.col(name))
    if refused:
        raise SchemaDrift("; ".join(refused))
    lost = F.lit(None).cast("string")
    for name, cast in reversed(list(casts.items())):
        lost = F.when(F.col(name).isNotNull() & cast.isNull(), F.lit(name)).otherwise(lost)
    return df.select(*columns, lost.alias("rejected"))


def change_of(before: str | None, after: str | None) -> str | None:
    """The event one column's types make, as :func:`schema_diff` names it."""
    if before is None:
        return "added"
    if after is None:
        return "removed"
    if before.lower() == after.lower():
        return None

    def base(t: str) -> str:
        zone = " with time zone" if t.lower().endswith(" with time zone") else ""
        t = t.lower().removesuffix(zone).split("(")[0].rstrip() + zone if "<" not in t else t.lower()
        for spelling, plain in (("list<", "array<"), ("tuple<", "struct<")):
            t = t.replace(spelling, plain, 1) if t.startswith(spelling) else t
        return "int" if t == "integer" else t

    a, b = base(before), base(after)
    if a in LADDER and b in LADDER and a != b:
        return "type_widened" if LADDER.index(a) < LADDER.index(b) else "type_narrowed"
    if a == b == "decimal":  # another precision or scale
        return "type_changed"
    if a == b or any(a in names and b in names for names in FAMILIES):
        return None
    return "type_changed"


# Avro's promotions, writer type to reader types.
AVRO_READS = {
    "int": ("long", "float", "double"),
    "long": ("float", "double"),
    "float": ("double",),
    "string": ("binary",),
    "binary": ("string",),
}
JSON_FAMILY = {"int": "long", "long": "long", "float": "double", "double": "double", "decimal": "double"}


def readable(fields: DataFrame, writer: str, reader: str, data_format: str) -> DataFrame:
    """``fields`` with ``readable``: can a reader of type ``reader`` read what ``writer`` wrote."""
    spark = fields.sparkSession
    w, r = F.lower(F.col(writer)), F.lower(F.col(reader))
    if data_format == "JSON":
        pairs = F.create_map(*[F.lit(x) for kv in JSON_FAMILY.items() for x in kv])
        a, b = F.coalesce(pairs[_base(w)], w), F.coalesce(pairs[_base(r)], r)
        return fields.withColumn("readable", (w == r) | (a == b) | ((a == "long") & (b == "double")))
    rules = spark.createDataFrame(
        [(a, b) for a, reads in AVRO_READS.items() for b in reads], "_w string, _r string"
    ).withColumn("_ok", F.lit(True))
    joined = fields.join(F.broadcast(rules), (w == F.col("_w")) & (r == F.col("_r")), "left")
    digits = r"^decimal\((\d+),\s*(\d+)\)$"
    both = w.rlike(digits) & r.rlike(digits)

    def part(c: Column, i: int) -> Column:
        return F.regexp_extract(c, digits, i).try_cast("int")

    grows = both & (part(w, 2) == part(r, 2)) & (part(r, 1) >= part(w, 1))
    ok = (w == r) | F.coalesce("_ok", F.lit(False)) | F.coalesce(grows, F.lit(False))
    return joined.withColumn("readable", ok).drop("_w", "_r", "_ok")


def _violations(value: Column, dtype: T.DataType, required: bool, label: str) -> list[tuple[Column, str]]:
    """``(test, reason)`` for each required value under ``value``, outer before inner."""
    found = []
    if required:
        found.append((value.isNull(), f"required field {label} is null"))
    if isinstance(dtype, T.StructType):
        for f in dtype.fields:
            inner = _violations(value[f.name], f.dataType, not f.nullable, f"{label}.{f.name}")
            found += [(value.isNotNull() & test, reason) for test, reason in inner]
    elif isinstance(dtype, T.ArrayType):
        found += _violations_of_each(value, dtype.elementType, not dtype.containsNull, label)
    elif isinstance(dtype, T.MapType):
        found += _violations_of_each(F.map_values(value), dtype.valueType, not dtype.valueContainsNull, label)
    return found


def _violations_of_each(values: Column, dtype: T.DataType, required: bool, label: str) -> list[tuple[Column, str]]:
    reasons = [reason for _, reason in _violations(F.lit(None), dtype, required, f"{label}[]")]

    def test(i: int) -> Column:
        return F.coalesce(
            F.exists(values, lambda x: _violations(x, dtype, required, f"{label}[]")[i][0]), F.lit(False)
        )

    return [(test(i), reason) for i, reason in enumerate(reasons)]


def required_violation(schema: T.StructType) -> Column:
    """The first required field that is null, at any depth, as a reason; NULL when all are there.

    A field is required when the spec says it is not nullable.
    """
    checks: list[tuple[Column, str]] = []
    for f in schema.fields:
        checks += _violations(F.col(f.name), f.dataType, not f.nullable, f.name)
    none = F.lit(None).cast("string")
    return reduce(lambda rest, check: F.when(check[0], F.lit(check[1])).otherwise(rest), reversed(checks), none)


def output_errors(df: DataFrame, schema: T.StructType, run_id: str) -> tuple[DataFrame, DataFrame]:
    """``(rows that pass, dead letters)``; a dead letter is ``error, row_json, run_id``."""
    checked = df.withColumn("_error", required_violation(schema))
    passed = checked.where("_error IS NULL").drop("_error")
    dead = checked.where("_error IS NOT NULL").select(
        F.col("_error").alias("error"),
        F.to_json(F.struct(*df.columns)).alias("row_json"),
        F.lit(run_id).alias("run_id"),
    )
    return passed, dead


def with_required(schema: T.StructType, paths: Sequence[str]) -> T.StructType:
    """``schema`` with every field nullable but the ``paths`` (``customer.id``, ``items[].sku``)."""

    def walk(dtype: T.DataType, at: str) -> T.DataType:
        if isinstance(dtype, T.StructType):
            return T.StructType(
                [
                    T.StructField(f.name, walk(f.dataType, f"{at}.{f.name}" if at else f.name), (f"{at}.{f.name}" if at else f.name) not in paths)
                    for f in dtype.fields
                ]
            )
        if isinstance(dtype, T.ArrayType):
            return T.ArrayType(walk(dtype.elementType, f"{at}[]"), f"{at}[]" not in paths)
        if isinstance(dtype, T.MapType):
            return T.MapType(dtype.keyType, walk(dtype.valueType, f"{at}[]"), f"{at}[]" not in paths)
        return dtype

    return walk(schema, "")
