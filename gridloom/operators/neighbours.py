"""Neighbour joins on a grid and the statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIX = ((-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))


def shifted(cells: DataFrame, offsets=SIX, *columns: str) -> DataFrame:
    """(x, y, z, k, columns): each cell's columns at the place of each cell that has it as neighbour ``k``.

    A neighbour join needs one shuffle of these rows: they are grouped by the cell that looks, not joined pair by pair.
    """
    places = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dz).alias("dz")) for k, (dx, dy, dz) in enumerate(offsets)))
    out = cells.select("x", "y", "z", *columns, F.explode(places).alias("o"))
    return out.select((F.col("x") - F.col("o.dx")).cast("int").alias("x"), (F.col("y") - F.col("o.dy")).cast("long").alias("y"), (F.col("z") - F.col("o.dz")).cast("long").alias("z"), F.col("o.k").alias("k"), *columns)


def with_neighbours(cells: DataFrame, column: str, default: Column, offsets=SIX) -> DataFrame:
    """The cells (one at a place) with an array ``near`` of the column's values at the offsets; where there is no cell, ``default``."""
    # the cell's own row goes along as one more offset, so there is one exchange and no join
    names = [k for k in cells.columns if k not in ("x", "y", "z")]
    own = cells.select("x", "y", "z", F.lit(None).cast("int").alias("k"), F.col(column).alias("_v"), F.struct(*names).alias("_row"))
    own = own.select(F.col("x").cast("int").alias("x"), F.col("y").cast("long").alias("y"), F.col("z").cast("long").alias("z"), "k", "_v", "_row")
    other = shifted(cells, offsets, column).withColumnRenamed(column, "_v").withColumn("_row", F.lit(None).cast(own.schema["_row"].dataType)).select(*own.columns)
    seen = [F.max(F.when(F.col("k") == k, F.col("_v"))).alias(f"_{k}") for k in range(len(offsets))]
    whole = own.union(other).groupBy("x", "y", "z").agg(*seen, F.any_value("_row", True).alias("_row")).filter(F.col("_row").isNotNull())
    near = F.array(*(F.coalesce(F.col(f"_{k}"), default) for k in range(len(offsets))))
    return whole.select("x", "y", "z", *(F.col(f"_row.`{k}`").alias(k) for k in names), near.alias("near"))


def previous_symbol(df: DataFrame, symbol: str, partition: str, *order: str) -> DataFrame:
    """(sym, ctx): each symbol with the one before it in its partition; '' for the first."""
    w = Window.partitionBy(partition).orderBy(*order)
    return df.select(F.col(symbol).alias("sym"), F.lag(symbol, 1, "").over(w).alias("ctx"))


def context_counts(pairs: DataFrame, *context: str) -> DataFrame:
    return pairs.groupBy(*context, "sym").agg(F.count("*").alias("n"))


def conditional_entropy(counts: DataFrame, *context: str) -> DataFrame:
    """(context, n, bits_per_symbol) from context_counts(); with no context at all, one row over everything.

    The total of each context is a second aggregation of the counts, joined back, not a window over the rows.
    """
    total = counts.groupBy(*context).agg(F.sum("n").alias("tot"))
    parts = counts.join(total, list(context)).withColumn("bits", -F.col("n") * F.log2(F.col("n") / F.col("tot")))
    return parts.groupBy(*context).agg(F.sum("n").alias("n"), F.round(F.sum("bits") / F.sum("n"), 6).alias("bits_per_symbol"))


def grid_contexts(cells: DataFrame) -> DataFrame:
    """(sym, xn, yn, zn): each cell's block with those before it on each axis; '' where there is none."""
    own = with_neighbours(cells, "block", F.lit(""), ((-1, 0, 0), (0, -1, 0), (0, 0, -1)))
    return own.select(F.col("block").alias("sym"), *(F.element_at("near", i + 1).alias(k) for i, k in enumerate(("xn", "yn", "zn"))))


def total_entropy(counts: DataFrame, *context: str) -> DataFrame:
    """(bits_per_block, n_blocks) over all contexts."""
    total = counts.groupBy(*context).agg(F.sum("n").alias("tot"))
    parts = counts.join(total, list(context))
    return parts.agg(F.round(F.sum(-F.col("n") * F.log2(F.col("n") / F.col("tot"))) / F.sum("n"), 6).alias("bits_per_block"), F.sum("n").alias("n_blocks"))


def brightest_neighbour(cells: DataFrame) -> DataFrame:
    """The cells with ``mn``, the largest light of their six neighbours (0 where there is none)."""
    return with_neighbours(cells, "light", F.lit(0)).withColumn("mn", F.greatest(F.array_max("near"), F.lit(0))).drop("near")


def emission_histogram(lit: DataFrame) -> DataFrame:
    """(block, bin, n): how often a block that is at least as bright as its neighbours has which light."""
    return lit.filter((F.col("light") > 0) & (F.col("light") >= F.col("mn"))).groupBy("block", F.col("light").alias("bin")).agg(F.count("*").alias("n"))


def emission_estimate(lit: DataFrame, share: float = 0.80, part: int = 12) -> DataFrame:
    """(block, emission): 0 if fewer than ``share`` of a block's cells have light, else its most frequent bin (the lowest of equals) above one in ``part``."""
    total = lit.groupBy("block").agg(F.count("*").alias("total"), F.count(F.when(F.col("light") > 0, 1)).alias("samples"))
    bins = emission_histogram(lit).join(total, "block").filter(F.col("n") > F.floor(F.col("samples") / part))
    best = bins.groupBy("block").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("best"))
    enough = (F.col("samples") > 0) & (F.col("samples") / F.col("total") >= share)
    return total.join(best, "block", "left").select("block", F.when(enough, F.coalesce("best", F.lit(0))).otherwise(0).cast("int").alias("emission"))


def opacity_histogram(lit: DataFrame, weight: int = 1) -> DataFrame:
    """(block, bin, n): by how much a cell is darker than its brightest neighbour, each cell counting ``weight`` times."""
    return lit.filter((F.col("mn") > 0) & (F.col("light") < F.col("mn"))).groupBy("block", (F.col("mn") - F.col("light")).alias("bin")).agg((F.count("*") * weight).alias("n"))


def opacity_estimate(histogram: DataFrame, part: int = 12) -> DataFrame:
    """(block, opacity): the highest bin above one in ``part`` of the block's samples; null if there is none."""
    total = histogram.groupBy("block").agg(F.sum("n").alias("samples"))
    return histogram.join(total, "block").groupBy("block").agg(F.max(F.when(F.col("n") > F.floor(F.col("samples") / part), F.col("bin"))).alias("opacity"))


def light_histogram(cells: DataFrame) -> DataFrame:
    return cells.groupBy("block", "light").agg(F.count("*").alias("n"))


def value_mode(df: DataFrame, key: str, value: Column, part: int = 12) -> DataFrame:
    """(key, emission, n): the most frequent value above one in ``part`` of the key's rows, the lowest of equals."""
    h = df.groupBy(key, value.alias("b")).agg(F.count("*").alias("n"))
    total = h.groupBy(key).agg(F.sum("n").alias("tot"))
    top = h.join(total, key).filter(F.col("n") > F.col("tot") / part).groupBy(key).agg(F.max_by(F.struct("b", "n"), F.struct("n", -F.col("b"))).alias("top"))
    return top.select(key, F.col("top.b").alias("emission"), F.col("top.n").alias("n"))
