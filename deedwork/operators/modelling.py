"""Hash-keyed hubs, links and satellites, dimensions, and facts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedwork.operators import slices


@dataclass(frozen=True)
class HashStrategy:
    algorithm: str = "sha256"
    delimiter: str = "||"
    null_token: str = "^^"
    upper_case: bool = True


DEFAULT = HashStrategy()


def _canonical(c: Column, s: HashStrategy) -> Column:
    text = F.trim(c.cast("string"))
    shown = F.upper(text) if s.upper_case else text
    return F.when(F.coalesce(text, F.lit("")) == "", s.null_token).otherwise(shown)


def _joined(parts: Sequence[Column], s: HashStrategy) -> Column:
    """What is hashed: equal where the hashes are."""
    return F.concat_ws(s.delimiter, *[_canonical(c, s) for c in parts])


def _hash(joined: Column, s: HashStrategy) -> Column:
    if s.algorithm == "md5":
        return F.md5(joined)
    if s.algorithm == "sha256":
        return F.sha2(joined, 256)
    raise ValueError(f"no hash algorithm {s.algorithm!r}")


def hash_key(columns: Sequence[str], s: HashStrategy = DEFAULT) -> Column:
    """The business key's hash. The order of the columns matters."""
    return _hash(_joined([F.col(c) for c in columns], s), s)


def hash_diff(columns: Sequence[str], s: HashStrategy = DEFAULT) -> Column:
    """The attributes' hash. The order of the columns does not matter."""
    parts = [
        F.concat(F.lit(f"{c.upper() if s.upper_case else c}="), _canonical(F.col(c), s)) for c in sorted(columns)
    ]
    return _hash(F.concat_ws(s.delimiter, *parts), s)


def load_hub(source: DataFrame, key: Sequence[str], loaded_at: str, held: DataFrame | None = None) -> DataFrame:
    """New hub rows: each business key once, at its first load, unless the hub has it."""
    rows = (
        source.dropna(subset=list(key))
        .groupBy(*key)
        .agg(F.min(loaded_at).alias("load_date"))
        .select(hash_key(key).alias("hub_key"), *key, "load_date")
    )
    return rows if held is None else rows.join(held.select("hub_key"), "hub_key", "left_anti")


def load_link(source: DataFrame, hubs: Sequence[Sequence[str]], loaded_at: str, held: DataFrame | None = None) -> DataFrame:
    """New link rows: each combination of the hubs' keys once."""
    columns = [c for key in hubs for c in key]
    rows = (
        source.dropna(subset=columns)
        .groupBy(*columns)
        .agg(F.min(loaded_at).alias("load_date"))
        .select(
            hash_key(columns).alias("link_key"),
            *[hash_key(key).alias(f"hub_key_{i}") for i, key in enumerate(hubs)],
            *columns,
            "load_date",
        )
    )
    return rows if held is None else rows.join(held.select("link_key"), "link_key", "left_anti")


def load_satellite(
    source: DataFrame, key: Sequence[str], attributes: Sequence[str], loaded_at: str, *, tie: Sequence[str] = (), tracking: str = "type2"
) -> DataFrame:
    """Satellite rows: all of them, the latest per key, or those whose attributes changed.

    A row's change is seen from the row before it of the same key, met in ranges of the whole order, so a key
    with a long history spreads over tasks. Rows are ordered and moved with their hashes as bytes, half as wide as the text and in its order.
    """
    rows = source.dropna(subset=list(key)).select(
        F.unhex(hash_key(key)).alias("hub_key"),
        F.struct(F.col(loaded_at).alias("load_date"), *tie, F.unhex(hash_diff(attributes)).alias("hash_diff"), *attributes).alias("row"),
    )
    shown = [
        F.lower(F.hex("hub_key")).alias("hub_key"),
        "row.load_date",
        F.lower(F.hex("row.hash_diff")).alias("hash_diff"),
        *[f"row.{a}" for a in attributes],
    ]
    if tracking == "append_only":
        return rows.select(*shown)
    if tracking == "type1":
        return rows.groupBy("hub_key").agg(F.max("row").alias("row")).select(*shown)
    if tracking != "type2":
        raise ValueError(f"no change tracking {tracking!r}")
    first = rows.groupBy("hub_key").agg(F.min("row").alias("row"))
    pairs = slices.next_in_order(rows.distinct(), ["hub_key"], "row", "then")
    changed = pairs.where(F.col("then").isNotNull() & (F.col("then.hash_diff") != F.col("row.hash_diff")))
    return first.unionByName(changed.select("hub_key", F.col("then").alias("row"))).select(*shown)


def point_in_time(hub: DataFrame, satellites: dict[str, DataFrame], snapshots: Sequence[str]) -> DataFrame:
    """Per hub key and snapshot date, the load date of each satellite's row valid then.

    The snapshots are stated, so each satellite needs one aggregation and no window.
    """
    out = hub.select("hub_key", F.explode(F.array(*[F.lit(s).cast("date") for s in snapshots])).alias("snapshot"))
    for name, satellite in satellites.items():
        held = satellite.groupBy("hub_key").agg(
            *[F.max(F.when(F.col("load_date") <= F.lit(s).cast("date"), F.col("load_date"))).alias(f"s{i}") for i, s in enumerate(snapshots)]
        )
        each = F.array(
            *[F.struct(F.lit(s).cast("date").alias("snapshot"), F.col(f"s{i}").alias(name)) for i, s in enumerate(snapshots)]
        )
        valid = held.select("hub_key", F.explode(each).alias("p")).select("hub_key", "p.snapshot", f"p.{name}")
        out = out.join(valid.where(F.col(name).isNotNull()), ["hub_key", "snapshot"], "left")
    return out


def bridge(
    first: DataFrame,
    second: DataFrame,
    *,
    on: str,
    hubs: tuple[Sequence[Sequence[str]], Sequence[Sequence[str]]] | None = None,
    s: HashStrategy = DEFAULT,
) -> DataFrame:
    """Two links walked through the hub key they share: the keys of both ends, and of the links.

    ``hubs`` states the business keys of both links' hubs, as they were given to :func:`load_link`, and ``s`` how they were hashed. The links then meet
    by the text that the shared key is the hash of, and move as business keys; the hashes, several times as wide, are made of the rows that met.
    """
    if hubs:
        names = [[[f"_{side}{i}_{j}" for j in range(len(key))] for i, key in enumerate(keys)] for side, keys in zip("ab", hubs, strict=True)]
        flat = [[c for key in keys for c in key] for keys in names]
        moved = [
            link.select(*[F.col(c).alias(n) for key, own in zip(keys, ours, strict=True) for c, n in zip(key, own, strict=True)])
            for link, keys, ours in zip((first, second), hubs, names, strict=True)
        ]
        met = [names[0][int(on.removeprefix("hub_key_"))], names[1][0]]
        a, b = (rows.withColumn("_via", _joined([F.col(c) for c in key], s)) for rows, key in zip(moved, met, strict=True))
        return a.join(b, "_via").select(
            hash_key(names[0][0], s).alias("start_key"),
            _hash(F.col("_via"), s).alias("via_key"),
            hash_key(names[1][1], s).alias("end_key"),
            hash_key(flat[0], s).alias("first_link"),
            hash_key(flat[1], s).alias("second_link"),
        )
    a = first.select(F.col("link_key").alias("first_link"), F.col("hub_key_0").alias("start_key"), F.col(on).alias("_via"))
    b = second.select(F.col("link_key").alias("second_link"), F.col("hub_key_0").alias("_via"), F.col("hub_key_1").alias("end_key"))
    return a.join(b, "_via").select("start_key", F.col("_via").alias("via_key"), "end_key", "first_link", "second_link")


OPEN_END = "9999-12-31"


def scd_apply(
    dimension: DataFrame, changes: DataFrame, key: Sequence[str], tracked: Sequence[str], *, type_: int, valid_on: str
) -> DataFrame:
    """A change batch applied to a dimension of type 1, 2, 3 or 6.

    ``dimension`` holds the key, the tracked columns, and per type: nothing more (1), ``valid_from``,
    ``valid_to``, ``is_current`` (2), ``previous_<c>`` (3), or all of type 2 with ``current_<c>`` (6).
    ``changes`` holds one row per key. Rows that are no longer current are never touched, except
    that type 6 shows the new values as current ones on every version.
    """
    key, tracked = list(key), list(tracked)
    new = changes.select(*key, *[F.col(c).alias(f"_n_{c}") for c in tracked], F.lit(True).alias("_hit"))
    day = F.lit(valid_on).cast("date")
    joined = dimension.join(new, key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    moved = hit & reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in tracked])
    fresh = new.join(dimension.select(*key).distinct(), key, "left_anti")
    taken = [F.col(f"_n_{c}").alias(c) for c in tracked]
    if type_ == 1:
        kept = joined.select(*key, *[F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in tracked])
        return kept.unionByName(fresh.select(*key, *taken))
    if type_ == 3:
        kept = joined.select(
            *key,
            *[F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in tracked],
            *[
                F.when(hit & ~F.col(c).eqNullSafe(F.col(f"_n_{c}")), F.col(c)).otherwise(F.col(f"previous_{c}")).alias(f"previous_{c}")
                for c in tracked
            ],
        )
        first = fresh.select(*key, *taken, *[F.lit(None).cast(dimension.schema[c].dataType).alias(f"previous_{c}") for c in tracked])
        return kept.unionByName(first)
    if type_ not in (2, 6):
        raise ValueError(f"no dimension type {type_}")
    current = F.col("is_current")
    shown = [
        F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(f"current_{c}")).alias(f"current_{c}") for c in tracked if type_ == 6
    ]
    kept = joined.select(
        *key,
        *tracked,
        "valid_from",
        F.when(current & moved, day).otherwise(F.col("valid_to")).alias("valid_to"),
        (current & ~moved).alias("is_current"),
        *shown,
    )
    span = [day.alias("valid_from"), F.lit(OPEN_END).cast("date").alias("valid_to"), F.lit(True).alias("is_current")]
    now = [F.col(f"_n_{c}").alias(f"current_{c}") for c in tracked if type_ == 6]
    opened = joined.where(current & moved).select(*key, *taken, *span, *now).unionByName(fresh.select(*key, *taken, *span, *now))
    return kept.unionByName(opened)


def fact_load(source: DataFrame, grain: Sequence[str], measures: dict[str, Column], keys: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """A fact table on its grain, its business keys resolved to dimension keys.

    ``keys``: the fact's key column to (dimension, source column, the dimension's business key, its
    surrogate key). The source is aggregated before it meets a dimension; a key no dimension row has
    becomes the unknown member.
    """
    facts = source.groupBy(*grain).agg(*[c.alias(name) for name, c in measures.items()])
    for name, (dimension, column, business, surrogate) in keys.items():
        found = dimension.select(F.col(business).alias("_b"), F.col(surrogate).alias("_s"))
        facts = (
            facts.join(found, F.col(column) == F.col("_b"), "left")
            .withColumn(name, F.coalesce("_s", F.lit("unknown")))
            .drop("_b", "_s")
        )
    return facts


