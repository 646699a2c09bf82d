"""Merges, differences, and lookups by version, alias or state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def symmetric_difference(left: DataFrame, right: DataFrame, keys: list[str], flag: str = "only_right") -> DataFrame:
    """(keys, flag): keys of one side only; applied again with the same right side it gives the left side back."""
    a, b = (d.select(*keys).distinct().withColumn(n, F.lit(True)) for d, n in ((left, "_a"), (right, "_b")))
    return a.join(b, keys, "full").filter("_a is null or _b is null").select(*keys, F.col("_a").isNull().alias(flag))


def merge_preferring(first: DataFrame, second: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, values) of either side; where both have a value the first's."""
    a, b = first.select(*keys, *(F.col(v).alias(f"_a{v}") for v in values)), second.select(*keys, *(F.col(v).alias(f"_b{v}") for v in values))
    return a.join(b, keys, "full").select(*keys, *(F.coalesce(f"_a{v}", f"_b{v}").alias(v) for v in values))


def merge_maps(first: Column, second: Column) -> Column:
    """A map with the entries of both; the first's where both have a key."""
    return F.map_concat(F.map_filter(second, lambda k, _: ~F.coalesce(F.map_contains_key(first, k), F.lit(False))), first)


def as_of(df: DataFrame, records: DataFrame, name: str, version: str, record_version: str = "v", old: str = "old", new: str = "new", result: str = "resolved") -> DataFrame:
    """Adds ``result``: the name's meaning in the record of the smallest version at or above the row's, else the name itself.

    The records (a dimension of renames) become one sorted array for each name, so the lookup is one equi-join, and rows
    are neither multiplied nor sorted.
    """
    history = records.groupBy(F.col(old).alias(name)).agg(F.array_sort(F.collect_list(F.struct(F.col(record_version).alias("v"), F.col(new).alias("n")))).alias("_h"))
    found = F.get(F.filter("_h", lambda r: F.col(version) <= r["v"]), F.lit(0))
    return df.join(history, name, "left").withColumn(result, F.coalesce(found["n"], F.col(name))).drop("_h")


def last_seen(df: DataFrame, when: Column, value: str, partition: str, *order: str, name: str = "prev") -> DataFrame:
    """Adds the largest ``value`` so far of the rows that meet the condition, in order in each partition."""
    from pyspark.sql import Window

    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.max(F.when(when, F.col(value))).over(w))


def alias_closure(spark, names: DataFrame, renames: DataFrame) -> DataFrame:
    """(name, latest, hops): where chains of renames (old, new) lead; a recursive query over the rename dimension."""
    first = names.columns[0]
    return spark.sql(
        """
      WITH RECURSIVE r(name, cur, depth) AS (
        SELECT name, name, 0 FROM {names}
        UNION ALL SELECT r.name, n.new, r.depth + 1 FROM r JOIN {renames} n ON n.old = r.cur)
      SELECT name, max_by(cur, depth) AS latest, max(depth) AS hops FROM r GROUP BY name""",
        names=names.select(F.col(first).alias("name")),
        renames=renames.select("old", "new"),
    )


def with_default(df: DataFrame, dimension: DataFrame, keys: list[str], defaults: dict[str, Column]) -> DataFrame:
    """A lookup whose missing entries are made up by default expressions."""
    found = df.join(dimension, keys, "left")
    return reduce(lambda d, x: d.withColumn(x[0], F.coalesce(F.col(x[0]), x[1])), defaults.items(), found)


def state_lookup(df: DataFrame, states: DataFrame, name: str = "name", properties: str = "props") -> DataFrame:
    """Joins on name and properties (maps), whatever their order, the state's default for a property that a row lacks.

    states: name, props (with all defaults), state_id, is_default.  A state that isn't known is created: its id is below 0,
    and equal states have equal ids.
    """
    defaults = states.filter("is_default").select(F.col(name), F.col(properties).alias("_d"))
    def key(m):
        return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")

    own = df.join(defaults, name, "left").withColumn("_k", key(merge_maps(F.coalesce(properties, F.create_map().cast("map<string,string>")), F.coalesce("_d", F.create_map().cast("map<string,string>")))))
    known = states.select(F.col(name), key(F.col(properties)).alias("_k"), "state_id")
    made = (-1 - F.shiftrightunsigned(F.xxhash64(name, "_k"), 1)).cast("long")
    return own.join(known, [name, "_k"], "left").withColumn("state_id", F.coalesce(F.col("state_id").cast("long"), made)).drop("_d", "_k")


def differences(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, what): rows of one side only, and rows whose values differ."""
    left, right = a.select(*keys, F.struct(*values).alias("_a"), F.lit(True).alias("_l")), b.select(*keys, F.struct(*values).alias("_b"), F.lit(True).alias("_r"))
    what = F.when(F.col("_l").isNull(), "right only").when(F.col("_r").isNull(), "left only").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return left.join(right, keys, "full").withColumn("what", what).filter("what is not null").select(*keys, "what")


def first_or_default(df: DataFrame, condition: Column, value: str, *order: str, default=None) -> DataFrame:
    """(value) of the first row in order that meets the condition; the default if none does.  One row; each task keeps its first."""
    own = df.filter(condition).agg(F.min_by(value, F.struct(*order)).alias(value))
    return own.select(F.coalesce(value, F.lit(default)).alias(value))


def lower_bound(values: Column, wanted: Column) -> Column:
    """The number of elements of a sorted array that lie below ``wanted``, by halving: 32 steps at most."""
    start = F.struct(F.lit(0).alias("a"), F.size(values).alias("b"))

    def half(s, _):
        middle = F.floor((s["a"] + s["b"]) / 2).cast("int")
        below = F.get(values, middle) < wanted
        return F.when(s["a"] >= s["b"], s).otherwise(F.struct(F.when(below, middle + 1).otherwise(s["a"]).alias("a"), F.when(below, s["b"]).otherwise(middle).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int")), start, half, lambda s: s["a"])


def both_ways(df: DataFrame, ids: str, names: str) -> tuple[DataFrame, DataFrame]:
    """(ids to names, names to ids) of a dimension; reading either fails where an id or a name stands twice."""
    def once(key: str, other: str) -> DataFrame:
        own = df.groupBy(key).agg(F.count("*").alias("_n"), F.first(other).alias(other))
        return own.filter(F.assert_true(F.col("_n") == 1, F.lit(f"{key} is not unique")).isNull()).drop("_n")

    return once(ids, names), once(names, ids)


def first_route(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = None
    for name, rule in rules:
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)
