"""Light: propagation to a fixed point, sky columns, border planes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.neighbours import SIX, shifted

#: Cells of a tile in which light is spread at once, without its rim: x, y, z.
TILE = (64, 128, 64)


def flood(levels: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Levels of a dense grid spread to a fixed point: a neighbour gets a level less its own cost (255: none can enter), the largest stays."""
    levels, cost = levels.astype(np.int16), cost.astype(np.int16)
    while True:
        best = levels.copy()
        for axis in range(levels.ndim):
            ahead = tuple(slice(1, None) if a == axis else slice(None) for a in range(levels.ndim))
            behind = tuple(slice(None, -1) if a == axis else slice(None) for a in range(levels.ndim))
            np.maximum(best[ahead], levels[behind] - cost[ahead], out=best[ahead])
            np.maximum(best[behind], levels[ahead] - cost[behind], out=best[behind])
        if np.array_equal(best, levels):
            return levels
        levels = best


def propagate(seeds: DataFrame, opacity: DataFrame, most: int = 15) -> DataFrame:
    """(x, y, z, lvl): light spread from ``seeds`` (x, y, z, lvl), losing max(1, op) of the cell that it enters (``opacity``: x, y, z, op); the largest level stays.

    A level of ``most`` at the largest reaches less than ``most`` cells far.  So each tile of cells is handed over with a rim of
    that width and flooded as a dense grid by itself: one exchange, and no rounds.
    """
    cost = opacity.select("x", "y", "z", F.greatest(F.lit(1), F.least(F.lit(254), F.col("op"))).cast("short").alias("op"), F.lit(0).cast("short").alias("lvl"))
    lit = seeds.filter("lvl > 0").select("x", "y", "z", F.lit(255).cast("short").alias("op"), F.least(F.lit(most), F.col("lvl")).cast("short").alias("lvl"))
    rows = cost.union(lit).select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("z").cast("long").alias("z"), "op", "lvl")
    tiles = [F.sequence(F.floor((F.col(k) - most) / n).cast("long"), F.floor((F.col(k) + most) / n).cast("long")) for k, n in zip("xyz", TILE, strict=True)]
    for name, each in zip(("tx", "ty", "tz"), tiles, strict=True):
        rows = rows.withColumn(name, F.explode(each))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["x", "y", "z"]].to_numpy(np.int64)
        least = at.min(axis=0)
        shape = at.max(axis=0) - least + 1
        place, op, lvl = tuple((at - least).T), pdf["op"].to_numpy(np.int16), pdf["lvl"].to_numpy(np.int16)
        cost, levels = np.full(shape, 255, np.int16), np.zeros(shape, np.int16)
        np.minimum.at(cost, place, op)
        np.maximum.at(levels, place, lvl)
        found = flood(levels, cost)
        first = np.array([pdf[k].iloc[0] * n for k, n in zip(("tx", "ty", "tz"), TILE, strict=True)]) - least
        inner = tuple(slice(max(0, int(a)), max(0, int(a) + n)) for a, n in zip(first, TILE, strict=True))
        own = np.argwhere(found[inner] > 0) + [s.start for s in inner]
        return pd.DataFrame(own + least, columns=["x", "y", "z"]).assign(lvl=found[tuple(own.T)])

    kinds = dict(opacity.dtypes)
    out = rows.groupBy("tx", "ty", "tz").applyInPandas(run, "x long, y long, z long, lvl int")
    return out.select(*(F.col(k).cast(kinds[k]).alias(k) for k in "xyz"), F.col("lvl").cast(dict(seeds.dtypes)["lvl"]).alias("lvl"))


def sky_columns(cells: DataFrame, heights: DataFrame, full: int = 15) -> DataFrame:
    """(x, y, z, lvl): cells at or above their column's height (x, z, h) have full light."""
    return cells.join(heights, ["x", "z"]).filter(F.col("y") >= F.col("h")).select("x", "y", "z", F.lit(full).alias("lvl"))


def sky_light(cells: DataFrame, heights: DataFrame, opacity: DataFrame, full: int = 15) -> DataFrame:
    """Sky light of all cells that have any: full columns, and what spreads from them sideways into lower gaps.

    Only lit cells beside a higher column can reach a dark one, so only they seed the spread.
    """
    lit = sky_columns(cells, heights, full)
    near = shifted(heights.select("x", F.lit(0).cast("long").alias("y"), "z", "h"), ((-1, 0, 0), (1, 0, 0), (0, 0, -1), (0, 0, 1)), "h").groupBy("x", "z").agg(F.max("h").alias("top"))
    own = lit.join(near, ["x", "z"], "left").join(heights, ["x", "z"])
    seeds = own.filter((F.col("y") < F.col("top")) | (F.col("y") == F.col("h"))).select("x", "y", "z", "lvl")
    spread = propagate(seeds, opacity, full)
    return lit.unionByName(spread).groupBy("x", "y", "z").agg(F.max("lvl").alias("lvl"))


def border_faces(cells: DataFrame, last: int, every_plane: bool = False) -> DataFrame:
    """The cells of a region's four outer planes with their ``face``; corner cells once, or in each plane if ``every_plane``."""
    x, z = F.col("x"), F.col("z")
    faces = [F.when(x == 0, "xn"), F.when(x == last, "xp"), F.when(z == 0, "zn"), F.when(z == last, "zp")]
    outer = cells.filter(x.isin(0, last) | z.isin(0, last))
    if every_plane:
        return outer.withColumn("face", F.explode(F.array_compact(F.array(*faces))))
    return outer.withColumn("face", F.coalesce(*faces))


def with_border_light(seeds: DataFrame, borders: DataFrame) -> DataFrame:
    """Seeds and stored border light (x, y, z, lvl) as seeds of one spread."""
    return seeds.select("x", "y", "z", "lvl").unionByName(borders.select("x", "y", "z", "lvl"))


def light_delta(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """(x, y, z, delta) where stored and computed levels differ; no level counts as 0."""
    a, b = stored.withColumnRenamed("lvl", "_a"), computed.withColumnRenamed("lvl", "_b")
    return a.join(b, ["x", "y", "z"], "full").select("x", "y", "z", (F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))).alias("delta")).filter("delta <> 0")
