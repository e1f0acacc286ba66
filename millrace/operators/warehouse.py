"""Dimension, history, vault and incremental loads.

Every load is a pure function from (target, source) tables to the new target: one
join on the keys, then projections and unions. Writing the result is the caller's
(see ``sources.snapshots``), so a load can be tried, tested and replayed.
Source rows must be unique by key; ``relational.deduplicate`` makes them so.
Times are parameters, not the clock, so a load that is run again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from millrace.functions.columns import all_same, row_digest
from millrace.functions.storage import written
from millrace.operators.relational import deduplicate


def _null(df: DataFrame, name: str) -> Column:
    return F.lit(None).cast(df.schema[name].dataType)


def _pairs(target: DataFrame, source: DataFrame, keys: Sequence[str], how: str = "full") -> DataFrame:
    """Rows of t and s side by side, with in_t and in_s."""
    t = target.withColumn("__t", F.lit(True)).alias("t")
    s = source.withColumn("__s", F.lit(True)).alias("s")
    return t.join(s, all_same("t", "s", keys), how).withColumns({"in_t": F.col("t.__t").isNotNull(), "in_s": F.col("s.__s").isNotNull()})


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Insert new keys and overwrite known ones; nothing is deleted. This is also a type 1 load."""
    j = _pairs(target, source, keys)
    pick = lambda c: F.when(F.col("in_s"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    return j.select(*[pick(c) for c in (*keys, *values)])


def upsert_counts(target: DataFrame, source: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """How many keys a type 1 load inserts, updates and leaves."""
    j = _pairs(target, source, keys)
    change = F.when(~F.col("in_t"), "inserted").when(~F.col("in_s"), "kept").when(all_same("t", "s", values), "unchanged").otherwise("updated")
    return j.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("rows"))


def delete_safe_sync(target: DataFrame, source: DataFrame, keys: Sequence[str], values: Sequence[str], at: Column, flag: str = "is_deleted", stamp: str = "deleted_at") -> DataFrame:
    """Upsert, and mark keys that the source no longer has; marks are taken back when a key returns."""
    j = _pairs(target, source, keys)
    pick = lambda c: F.when(F.col("in_s"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    gone_before = F.coalesce(F.col(f"t.{flag}"), F.lit(False))
    return j.select(
        *[pick(c) for c in (*keys, *values)],
        (~F.col("in_s")).alias(flag),
        F.when(F.col("in_s"), None).when(gone_before, F.col(f"t.{stamp}")).otherwise(at).alias(stamp),
    )


def scd2(target: DataFrame, source: DataFrame, keys: Sequence[str], tracked: Sequence[str], at: Column, valid_from: str = "valid_from", valid_to: str = "valid_to", current: str = "is_current") -> DataFrame:
    """History load: close the current row of a changed key and add a new one; keys not in the source stay.

    Closed rows pass through a union, so only current rows are joined.
    """
    columns = [*keys, *tracked, valid_from, valid_to, current]
    closed = target.where(~F.col(current)).select(*columns)
    j = _pairs(target.where(F.col(current)), source, keys)
    changed = F.col("in_t") & F.col("in_s") & ~all_same("t", "s", tracked)
    kept = j.where("in_t").select(
        *[F.col(f"t.{c}") for c in (*keys, *tracked, valid_from)],
        F.when(changed, at).otherwise(F.col(f"t.{valid_to}")).alias(valid_to),
        (~changed).alias(current),
    )
    fresh = j.where(F.col("in_s") & (~F.col("in_t") | changed)).select(
        *[F.col(f"s.{c}") for c in (*keys, *tracked)], at.alias(valid_from), _null(target, valid_to).alias(valid_to), F.lit(True).alias(current)
    )
    return closed.union(kept).union(fresh)


def scd3(target: DataFrame, source: DataFrame, keys: Sequence[str], tracked: Sequence[str], suffix: str = "_previous") -> DataFrame:
    """Current and one earlier value of each tracked column."""
    j = _pairs(target, source, keys)
    changed = F.col("in_t") & F.col("in_s") & ~all_same("t", "s", tracked)
    now = lambda c: F.when(F.col("in_s"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    before = lambda c: F.when(changed, F.col(f"t.{c}")).otherwise(F.col(f"t.{c}{suffix}")).alias(c + suffix)
    return j.select(*[now(c) for c in (*keys, *tracked)], *[before(c) for c in tracked])


def surrogate_keys(new: DataFrame, known: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """Number new rows from the largest known key on, in the given order.

    Ranges of the order are counted first, then numbered inside, so many tasks share
    the numbering. The sorted rows are written once, as both steps must see the same ranges.
    """
    top = known.agg(F.coalesce(F.max(name), F.lit(0)).cast("long").alias("top"))
    sorted_ = written(new.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    sizes = sorted_.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("__row"))
    numbered = sorted_.withColumn("__inside", inside).join(before, "__part")
    return numbered.join(F.broadcast(top)).withColumn(name, F.col("top") + F.col("__before") + F.col("__inside")).drop("__part", "__row", "__n", "__before", "__inside", "top")


def mini_dimension(source: DataFrame, mini: DataFrame, attributes: Sequence[str], key: str = "mini_sk") -> DataFrame:
    """The mini-dimension with the source's new combinations of attributes (type 4)."""
    combos = source.select(*attributes).distinct().alias("s")
    new = combos.join(mini.alias("t"), all_same("s", "t", attributes), "left_anti")
    return mini.select(key, *attributes).unionByName(surrogate_keys(new, mini, key, list(attributes)).select(key, *attributes))


def attach_mini(main: DataFrame, mini: DataFrame, attributes: Sequence[str], key: str = "mini_sk", names: Sequence[str] = ("mini_sk",)) -> DataFrame:
    """The main dimension with the mini-dimension's key; two names give the type 5 form (fact key and current key)."""
    joined = main.alias("s").join(mini.alias("t"), all_same("s", "t", attributes), "left")
    return joined.select("s.*", *[F.col(f"t.{key}").alias(n) for n in names])


def scd6(target: DataFrame, source: DataFrame, keys: Sequence[str], tracked: Sequence[str], at: Column) -> DataFrame:
    """Type 2 rows with current_* of the key on every row and previous_* on the rows that replaced another."""
    base = scd2(target, source, keys, tracked, at)
    by = Window.partitionBy(*keys)
    newest = by.orderBy(F.col("is_current").asc(), F.col("valid_from").asc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = by.orderBy("valid_from")
    return base.withColumns({f"current_{c}": F.last(c).over(newest) for c in tracked} | {f"previous_{c}": F.lag(c).over(back) for c in tracked})


def scd7(target: DataFrame, source: DataFrame, keys: Sequence[str], tracked: Sequence[str], at: Column, key: str = "scd_id") -> DataFrame:
    """Type 2 rows with a surrogate key and current_* of the key on every row."""
    base = scd2(target.drop(key, *[f"current_{c}" for c in tracked]), source, keys, tracked, at)
    known = target.select(key, *[F.col(k).alias(f"__{k}") for k in keys], F.col("valid_from").alias("__from"))
    same = F.col("valid_from") == F.col("__from")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    matched = base.join(known, same, "left").drop("__from", *[f"__{k}" for k in keys])
    old, new = matched.where(F.col(key).isNotNull()), matched.where(F.col(key).isNull()).drop(key)
    rows = old.unionByName(surrogate_keys(new, target, key, list(keys)))
    newest = Window.partitionBy(*keys).orderBy("is_current", "valid_from").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns({f"current_{c}": F.last(c).over(newest) for c in tracked})


def snapshot_by_digest(target: DataFrame, source: DataFrame, keys: Sequence[str], tracked: Sequence[str], at: Column) -> DataFrame:
    """Type 2 history where a change is a different md5 of the tracked columns, kept as row_hash."""
    hashed = source.withColumn("row_hash", row_digest(tracked))
    j = _pairs(target.where("is_current"), hashed, keys)
    changed = F.col("in_t") & F.col("in_s") & (F.col("t.row_hash") != F.col("s.row_hash"))
    columns = [*keys, *tracked, "row_hash", "valid_from", "valid_to", "is_current"]
    kept = j.where("in_t").select(*[F.col(f"t.{c}") for c in (*keys, *tracked, "row_hash", "valid_from")], F.when(changed, at).otherwise(F.col("t.valid_to")).alias("valid_to"), (~changed).alias("is_current"))
    fresh = j.where(F.col("in_s") & (~F.col("in_t") | changed)).select(*[F.col(f"s.{c}") for c in (*keys, *tracked, "row_hash")], at.alias("valid_from"), _null(target, "valid_to").alias("valid_to"), F.lit(True).alias("is_current"))
    return target.where("NOT is_current").select(*columns).union(kept).union(fresh)


# Data vault ------------------------------------------------------------------
def hash_key(names: Sequence[str]) -> Column:
    return row_digest(names)


def load_hub(hub: DataFrame, source: DataFrame, business_keys: Sequence[str], loaded: Column, record_source: str, key: str = "hk") -> DataFrame:
    """New business keys only: (hash key, business keys, load_date, record_source)."""
    new = source.select(hash_key(business_keys).alias(key), *business_keys).dropDuplicates([key]).join(hub.select(key), key, "left_anti")
    return hub.select(key, *business_keys, "load_date", "record_source").union(new.select(key, *business_keys, loaded.alias("load_date"), F.lit(record_source).alias("record_source")))


def load_link(link: DataFrame, source: DataFrame, hubs: Mapping[str, Sequence[str]], loaded: Column, record_source: str, key: str = "link_hk") -> DataFrame:
    """New relations only; hubs: hash key column to its business keys."""
    keyed = source.select(*[hash_key(cols).alias(name) for name, cols in hubs.items()]).withColumn(key, row_digest(list(hubs)))
    new = keyed.dropDuplicates([key]).join(link.select(key), key, "left_anti")
    return link.select(key, *hubs, "load_date", "record_source").union(new.select(key, *hubs, loaded.alias("load_date"), F.lit(record_source).alias("record_source")))


def load_satellite(satellite: DataFrame, source: DataFrame, business_keys: Sequence[str], attributes: Sequence[str], loaded: Column, key: str = "hk") -> DataFrame:
    """Attribute history of a hub: a new row when the digest of the attributes changes, the open one closed."""
    keyed = source.select(hash_key(business_keys).alias(key), *attributes, row_digest(attributes).alias("hash_diff"))
    open_ = satellite.where("load_end_date IS NULL")
    j = _pairs(open_, keyed, [key])
    changed = F.col("in_t") & F.col("in_s") & (F.col("t.hash_diff") != F.col("s.hash_diff"))
    kept = j.where("in_t").select(*[F.col(f"t.{c}") for c in (key, *attributes, "hash_diff", "load_date")], F.when(changed, loaded).alias("load_end_date"))
    fresh = j.where(F.col("in_s") & (~F.col("in_t") | changed)).select(*[F.col(f"s.{c}") for c in (key, *attributes, "hash_diff")], loaded.alias("load_date"), _null(satellite, "load_end_date").alias("load_end_date"))
    done = satellite.where("load_end_date IS NOT NULL").select(key, *attributes, "hash_diff", "load_date", "load_end_date")
    return done.union(kept).union(fresh)


def point_in_time(spine: DataFrame, satellites: Mapping[str, DataFrame], key: str = "hk", snapshot: str = "snapshot_date") -> DataFrame:
    """For each (key, snapshot) the load date of the row of every satellite that was valid then, or null.

    As-of by union and one ordered window a satellite: linear in rows, where an inequality join pairs them all.
    """
    out = spine
    for name, satellite in satellites.items():
        marks = satellite.select(key, F.col("load_date").alias("__at"), F.lit(0).alias("__kind"), F.col("load_date").alias("__load"), F.col("load_end_date").alias("__end"))
        asks = spine.select(key, F.col(snapshot).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(satellite.schema["load_date"].dataType).alias("__load"), F.lit(None).cast(satellite.schema["load_end_date"].dataType).alias("__end")).distinct()
        so_far = Window.partitionBy(key).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
        row = F.last(F.when(F.col("__kind") == 0, F.struct("__load", "__end")), ignorenulls=True).over(so_far)
        seen = marks.union(asks).withColumn("__row", row).where("__kind = 1")
        valid = F.col("__row.__end").isNull() | (F.col("__row.__end") > F.col("__at"))
        picked = seen.select(F.col(key).alias("__k"), F.col("__at").alias("__s"), F.when(valid, F.col("__row.__load")).alias(f"{name}_load_date"))
        out = out.join(picked, out[key].eqNullSafe(picked["__k"]) & (out[snapshot] == picked["__s"]), "left").drop("__k", "__s")
    return out


def vault_bridge(link: DataFrame, hubs: Mapping[str, tuple[DataFrame, Sequence[str]]], key: str = "link_hk", hub_key: str = "hk") -> DataFrame:
    """A link flattened to the business keys of its hubs; hubs: link column to (hub, columns)."""
    out = link.select(key, *hubs)
    for column, (hub, wanted) in hubs.items():
        one = hub.select(F.col(hub_key).alias(column), *wanted).dropDuplicates([column])
        out = out.join(one, column, "left")
    return out


# Dimensional -----------------------------------------------------------------
def bridge_table(df: DataFrame, group: Sequence[str], members: Sequence[str], weight: str | None = None) -> DataFrame:
    """Many-to-many bridge; weights from a column, or equal parts of a group."""
    w = F.col(weight).cast("double") if weight else 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*group))
    return df.select(*group, *members, w.alias("weight"))


def date_dimension(spark, start: str, end: str, fiscal_start: int = 1) -> DataFrame:
    """One row a day from start to end, both included."""
    d = F.col("date")
    fiscal = F.year(d) + F.when((F.month(d) >= fiscal_start) & F.lit(fiscal_start > 1), 1).otherwise(0)
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day"))).alias("date"))
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"),
        "date",
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.weekofyear(d).alias("week"),
        F.dayofmonth(d).alias("day"),
        (F.weekday(d) + 1).alias("day_of_week"),
        (F.weekday(d) >= 5).alias("is_weekend"),
        fiscal.cast("int").alias("fiscal_year"),
    )


def load_dimension(target: DataFrame, source: DataFrame, keys: Sequence[str], values: Sequence[str], key: str = "sk") -> DataFrame:
    """Type 1 dimension with surrogate keys that go on from the largest."""
    j = _pairs(target, source, keys)
    pick = lambda c: F.when(F.col("in_s"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    known = j.where("in_t").select(F.col(f"t.{key}").cast("long").alias(key), *[pick(c) for c in (*keys, *values)])
    new = j.where("NOT in_t").select(*[F.col(f"s.{c}") for c in (*keys, *values)])
    return known.unionByName(surrogate_keys(new, target, key, list(keys)))


def load_fact(facts: DataFrame, dimensions: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[str], str]], columns: Sequence[str], unknown: int = -1) -> DataFrame:
    """Facts with surrogate keys; dimensions: name to (table, fact columns, natural keys, surrogate key).

    A key that a dimension does not know becomes ``unknown`` and counts as late.
    """
    out, late = facts, F.lit(0)
    for name, (dim, fact_columns, natural, key) in dimensions.items():
        own = dim.select(*[F.col(n).alias(f"__{n}") for n in natural], F.col(key).alias(f"{name}_sk"))
        condition = F.lit(True)
        for f, n in zip(fact_columns, natural, strict=True):
            condition = condition & (F.col(f) == F.col(f"__{n}"))
        out = out.join(own, condition, "left").drop(*[f"__{n}" for n in natural])
        late = late + F.col(f"{name}_sk").isNull().cast("int")
    return out.select(*columns, *[F.coalesce(f"{n}_sk", F.lit(unknown)).cast("long").alias(f"{n}_sk") for n in dimensions], (late > 0).alias("is_late"))


# Ingestion and layers ----------------------------------------------------------
def newer_than(df: DataFrame, target: DataFrame, watermark: str, target_watermark: str | None = None) -> DataFrame:
    """Rows strictly past the target's high-water mark; all rows for an empty target.

    The mark is read first, so that it reaches the scan as a literal filter.
    """
    mark = target.agg(F.max(target_watermark or watermark).alias("m")).first()["m"]
    return df if mark is None else df.where(F.col(watermark) > F.lit(mark).cast(df.schema[watermark].dataType))


def bronze(df: DataFrame, source_uri: str, ingested_at: Column) -> DataFrame:
    return df.withColumns({"ingested_at": ingested_at, "source_uri": F.lit(source_uri)})


def silver(df: DataFrame, casts: Mapping[str, str], valid: str | Column, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Cast, drop invalid rows, keep the first of each key."""
    typed = df.withColumns({c: F.col(c).try_cast(t) for c, t in casts.items()})
    return deduplicate(typed.where(valid), keys, order)


def append_snapshot(target: DataFrame | None, source: DataFrame, day: Column, name: str = "_snapshot_date") -> DataFrame:
    dated = source.withColumn(name, day)
    return dated if target is None else target.unionByName(dated)


def apply_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str], values: Sequence[str], offset: str = "offset", op: str = "op") -> DataFrame:
    """Apply change events: the last one of each key counts; c, r and u set its row, d removes it."""
    last = deduplicate(changes, keys, [F.col(offset).desc()])
    j = _pairs(target, last, keys)
    pick = lambda c: F.when(F.col("in_s"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    return j.where(~F.col("in_s") | (F.col(f"s.{op}") != "d")).select(*[pick(c) for c in (*keys, *values)])


def parse_changes(df: DataFrame, envelope: str, schema: str, keep: Sequence[str] = ("offset",)) -> tuple[DataFrame, DataFrame]:
    """(changes, malformed) from JSON envelopes of op, before and after; a deletion takes its row from before."""
    parsed = df.withColumn("__e", F.from_json(envelope, f"op string, before struct<{schema}>, after struct<{schema}>, ts_ms long"))
    good = F.col("__e.op").isin("c", "r", "u", "d") & F.when(F.col("__e.op") == "d", F.col("__e.before").isNotNull()).otherwise(F.col("__e.after").isNotNull())
    good = F.coalesce(good, F.lit(False))
    row = F.when(F.col("__e.op") == "d", F.col("__e.before")).otherwise(F.col("__e.after"))
    return parsed.where(good).select(*keep, F.col("__e.op").alias("op"), row.alias("__row")).select(*keep, "op", "__row.*"), parsed.where(~good).drop("__e")


def one_per_key(source: DataFrame, keys: Sequence[str], policy: str = "error", order: Sequence[str | Column] = ()) -> DataFrame:
    """``source`` with one row a key, for loads that must not multiply rows.

    error: the load fails at the first key that stands twice (checked while rows are read, no extra job); first, last: the row
    that comes first or last in the order. Null keys are keys.
    """
    if policy == "error":
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
        checked = source.withColumn("__n", F.when(number > 1, F.raise_error(F.concat(F.lit("duplicate key: "), F.to_json(F.struct(*keys)))).cast("int")).otherwise(1))
        return checked.where("__n = 1").drop("__n")
    if policy not in ("first", "last") or not order:
        raise ValueError("policy must be error, first or last; the latter two need an order")
    struct = F.struct(*source.columns)
    place = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    best = (F.min_by if policy == "first" else F.max_by)(struct, place).alias("__row")
    return source.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(best).select("__row.*")


def append_only(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``source`` whose key the target does not hold: what an append-only ingest writes; null keys are keys."""
    pairs = all_same("s", "t", keys)
    return source.alias("s").join(target.select(*keys).distinct().alias("t"), pairs, "left_anti")


def strict_changes(df: DataFrame, envelope: str, schema: str, keep: Sequence[str] = ("offset",)) -> DataFrame:
    """Envelopes as columns op, before, after, source and ts_ms; the first that is no JSON object or has no known op fails the read.

    schema: of the row images. Known ops: c, u, d, r.
    """
    kind = f"op string, before struct<{schema}>, after struct<{schema}>, source string, ts_ms long"
    parsed = F.from_json(F.col(envelope), kind)
    bad = F.col("e").isNull() | ~F.coalesce(F.col("e.op").isin("c", "u", "d", "r"), F.lit(False))
    fail = F.raise_error(F.concat(F.lit("malformed change: "), F.coalesce(F.col(envelope), F.lit("null"))))
    # A filter, as a check in a column goes with a column that is not used.
    read = df.withColumn("e", parsed).where(F.when(bad, fail.cast("boolean")).otherwise(F.lit(True)))
    return read.select(*keep, "e.op", "e.before", "e.after", "e.source", "e.ts_ms")


def pending_migrations(applied: DataFrame, migrations: Sequence[tuple[int, str]], version: str = "version") -> list[tuple[int, str]]:
    """The migrations to apply, in order; a gap after what was applied, or versions that do not rise, raise ValueError."""
    numbers = [v for v, _ in migrations]
    if not numbers or any(b <= a for a, b in zip([0, *numbers], numbers, strict=False)):
        raise ValueError("migrations must have rising positive versions")
    top = applied.agg(F.max(version)).first()[0] or 0
    done = {r[0] for r in applied.where(F.col(version).isin(numbers)).select(version).collect()}
    expected, found = top + 1, []
    for number, statement in migrations:
        if number in done:
            continue
        if number != expected:
            raise ValueError(f"version gap: expected {expected}, got {number}")
        found.append((number, statement))
        expected += 1
    return found
