"""Replacing cells that can't be seen by what is frequent around them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.neighbours import SIX, with_neighbours


def _judged(cells: DataFrame, transparent: Column, offsets) -> DataFrame:
    """The cells with ``_hidden`` (six neighbours, none of them transparent) and ``near``, the blocks at the offsets (null where there is none); one exchange."""
    every = [*SIX, *(o for o in offsets if tuple(o) not in SIX)]
    own = with_neighbours(cells.withColumn("_seen", F.struct("block", transparent.alias("clear"))), "_seen", F.lit(None).cast("struct<block:string,clear:boolean>"), every)
    six = F.slice("near", 1, 6)
    chosen = F.array(*(F.get("near", F.lit(every.index(tuple(o))))["block"] for o in offsets))
    return own.withColumn("_hidden", F.forall(six, lambda s: s.isNotNull() & ~F.coalesce(s["clear"], F.lit(False)))).withColumn("near", chosen).drop("_seen")


def _mode(blocks: Column) -> Column:
    """(n, block) of the most frequent of an array of blocks, ties to the first in order."""
    held = F.filter(blocks, lambda b: b.isNotNull())
    ranked = F.transform(F.array_distinct(held), lambda b: F.struct((-F.size(F.filter(held, lambda o: o == b))).alias("n"), b.alias("block")))
    return F.array_min(ranked)


def replacements(cells: DataFrame, transparent: Column, offsets=SIX) -> DataFrame:
    """(x, y, z, replacement, n): for each hidden cell, the most frequent block at the offsets, ties to the first in order."""
    best = _judged(cells, transparent, offsets).filter("_hidden").select("x", "y", "z", _mode(F.col("near")).alias("top")).filter("top is not null")
    return best.select("x", "y", "z", F.col("top.block").alias("replacement"), (-F.col("top.n")).cast("long").alias("n"))


def replace_hidden(cells: DataFrame, transparent: Column, whitelist: Column | list[str] | None = None, offsets=SIX) -> DataFrame:
    """The cells, hidden ones with their replacement; only blocks of the whitelist (names, or a condition) if one is given."""
    may = F.lit(True) if whitelist is None else F.col("block").isin(whitelist) if isinstance(whitelist, list) else whitelist
    own = _judged(cells, transparent, offsets)
    new = F.when(F.col("_hidden") & may, _mode(F.col("near"))["block"])
    return own.withColumn("block", F.coalesce(new, F.col("block"))).select(*cells.columns)


def smooth_sequence(df: DataFrame, symbol: str, partition: str, *order: str) -> DataFrame:
    """The rows with a symbol between two equal others replaced by them."""
    w = Window.partitionBy(partition).orderBy(*order)
    p, n = F.lag(symbol).over(w), F.lead(symbol).over(w)
    return df.withColumn(symbol, F.when((p == n) & (p != F.col(symbol)), p).otherwise(F.col(symbol)))


def neighbour_sample(radius: int, count: int, seed: int = 12345) -> list[tuple[int, int, int]]:
    """``count`` offsets of a cube of ``radius``, without the cell and its six neighbours; by a seeded shuffle, then in order."""
    r = range(-radius, radius + 1)
    every = [(x, y, z) for y in r for z in r for x in r if (x, y, z) != (0, 0, 0) and (x, y, z) not in SIX]
    picked = np.random.default_rng(seed).permutation(len(every))[:count]
    return [every[i] for i in sorted(picked)]


def running_replacements(cells: DataFrame, region: str, offsets, decay: bool = False) -> DataFrame:
    """Cells that can't be seen become the block counted most so far around such cells, in cell order.

    Every cell that may be replaced counts the touching cells one by one, up to the first that is clear or isn't there; if
    all six hide it, the cells at the offsets too, and the block with the largest count (of equals the one that had it first) takes
    its place and is what later cells see.  Counts go on from cell to cell; ``decay`` starts them anew at each.  Columns of the
    cells tell which blocks are clear (``_clear``) and which may be replaced (``_may``); both hold for all cells of a block.

    The order matters, so a region is one group.  A region is 32 chunks a side, so its size doesn't grow with the data.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "z", "x"], kind="stable").reset_index(drop=True)
        names, code = np.unique(pdf["block"].to_numpy(str), return_inverse=True)
        first = np.unique(code, return_index=True)[1]
        clear, may = (pdf[k].to_numpy(bool)[first].tolist() for k in ("_clear", "_may"))
        # the region as a grid with a border; -1 where there is no cell
        reach = max([1, *(abs(v) for o in offsets for v in o)])
        place = pdf[["y", "z", "x"]].to_numpy(np.int64)
        place = place - place.min(axis=0) + reach
        shape = place.max(axis=0) + reach + 1
        grid = np.full(int(shape.prod()), -1, np.int64)
        flat = np.ravel_multi_index(place.T, shape)
        grid[flat] = code
        steps = [[(dy * int(shape[1]) + dz) * int(shape[2]) + dx for dx, dy, dz in own] for own in (SIX, offsets)]
        grid, counts, top = grid.tolist(), [0] * len(names), 0
        for i in flat.tolist():
            if not may[grid[i]]:
                continue
            if decay:
                counts, top = [0] * len(names), 0

            def seen(b: int) -> None:
                nonlocal top
                counts[b] += 1
                if counts[b] > counts[top]:
                    top = b

            for d in steps[0]:
                b = grid[i + d]
                if b < 0 or clear[b]:
                    break
                seen(b)
            else:
                for d in steps[1]:
                    if grid[i + d] >= 0:
                        seen(grid[i + d])
                grid[i] = top
        pdf["block"] = names[np.array(grid)[flat]]
        return pdf

    return cells.groupBy(region).applyInPandas(run, cells.schema)
