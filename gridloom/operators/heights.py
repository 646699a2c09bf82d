"""Column tops: computing, predicting, and the difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_top(df: DataFrame, keys: list[str], position: str, opaque: Column, least: int = 0, name: str = "height") -> DataFrame:
    """(keys, name): one more than the largest position of an opaque row of each column; ``least`` if it has none."""
    return df.groupBy(*keys).agg(F.coalesce(F.max(F.when(opaque, F.col(position))) + 1, F.lit(least)).cast("long").alias(name))


def heightmap(cells: DataFrame, opaque: Column, least: int = 0, name: str = "h") -> DataFrame:
    return column_top(cells, ["x", "z"], "y", opaque, least, name)


def deltas(actual: DataFrame, predicted: DataFrame, keys: list[str], value: str = "height") -> DataFrame:
    """(keys, delta): actual less predicted; what only one side has counts as 0 on the other."""
    a, b = actual.withColumnRenamed(value, "_a"), predicted.withColumnRenamed(value, "_b")
    return a.join(b, keys, "full").select(*keys, (F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))).alias("delta"))


def undo_deltas(delta: DataFrame, predicted: DataFrame, keys: list[str], value: str = "height") -> DataFrame:
    """The inverse of deltas() for columns that have an actual value."""
    return delta.join(predicted.withColumnRenamed(value, "_b"), keys, "left").select(*keys, (F.col("delta") + F.coalesce("_b", F.lit(0))).alias(value))


def top_blocks(cells: DataFrame, heights: DataFrame) -> DataFrame:
    """(block, hits): how often each block lies just below its column's height (heights: x, z, h)."""
    at = heights.filter(F.col("h").isNotNull()).select("x", "z", (F.col("h") - 1).alias("y"))
    return cells.join(at, ["x", "z", "y"]).groupBy("block").agg(F.count("*").alias("hits"))


def known_kinds(df: DataFrame, key: str, kind: Column) -> DataFrame:
    """(key, mask): a bit for each kind (a number below 32) that a key has."""
    return df.groupBy(key).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), kind.cast("int"))).alias("mask"))


def needs_heightmap(version: Column, status: Column, kind: Column, first_version: int, full_status: str = "full") -> Column:
    """Whether a heightmap kind is to be computed: world-generation kinds (``_WG``) only for chunks that aren't full."""
    generating = F.coalesce(kind.endswith("_WG"), F.lit(False))
    return F.when(version < first_version, ~generating).otherwise(F.when(status == full_status, ~generating).otherwise(True))
