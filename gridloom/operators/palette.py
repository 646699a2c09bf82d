"""Dictionaries: palettes by frequency or by first sight, remapping, string pools, shared attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranges import with_range

#: Ids of a palette are below this.
ID_LIMIT = 65535


def _palette(symbols: DataFrame, *order: str | Column) -> DataFrame:
    # a palette holds fewer than ID_LIMIT symbols, so one task numbers it
    return symbols.withColumn("sym_id", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))


def numbered(rows: DataFrame, *order: str | Column, name: str = "sym_id", start: int = 0) -> DataFrame:
    """The rows, however many, numbered in order without a task that sees all of them: by ranges of the order, and the rows of the ranges before."""
    own = with_range(rows, *order)
    sizes = own.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # as many rows as ranges
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return own.withColumn("_i", place).join(F.broadcast(before), "_p").withColumn(name, (F.col("_i") + F.col("_b") + (start - 1)).cast("int")).drop("_p", "_i", "_b")


def palette_by_frequency(df: DataFrame, symbol: str = "block") -> DataFrame:
    """(symbol, n, sym_id): the most frequent symbol is 0, ties by the symbol."""
    return of_counts(df.groupBy(symbol).agg(F.count("*").alias("n")), symbol)


def of_counts(counts: DataFrame, symbol: str = "block") -> DataFrame:
    """The palette of symbols that are counted already (symbol, n)."""
    return _palette(counts, F.desc("n"), symbol)


def palette_first_seen(df: DataFrame, symbol: str, position: str) -> DataFrame:
    """(symbol, first, sym_id): symbols by the smallest position at which they stand."""
    first = df.groupBy(symbol).agg(F.min(position).alias("first"))
    return _palette(first, "first")


def checked_palette(palette: DataFrame) -> DataFrame:
    """The palette, failing when read if an id reaches the limit."""
    good = F.assert_true(F.col("sym_id") < ID_LIMIT, F.lit("a palette holds fewer than 65,535 symbols"))
    return palette.filter(good.isNull())


def remap(df: DataFrame, palette: DataFrame, symbol: str = "block") -> DataFrame:
    """Adds sym_id.  Spark broadcasts the palette if its size after the aggregation is small enough."""
    return df.join(palette.select(symbol, "sym_id"), symbol)


def string_pool(df: DataFrame, column: str, size: int = 256) -> DataFrame:
    """(column, freq): the ``size`` most frequent strings that occur more than once."""
    return df.groupBy(column).agg(F.count("*").alias("freq")).filter("freq > 1").orderBy(F.desc("freq"), column).limit(size)


def grouped_names(df: DataFrame, name: str, attributes: list[str]) -> DataFrame:
    """(attributes, names): names of equal attributes, in order."""
    return df.groupBy(*attributes).agg(F.array_sort(F.collect_set(name)).alias("names"))


def collapse_constant(values):
    """A one-element array of an array whose values are all equal, else the array."""
    return F.when(F.size(F.array_distinct(values)) == 1, F.slice(values, 1, 1)).otherwise(values)


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(column, code): distinct values, numbered from 1 in their order; 0 is left for what is new."""
    return numbered(df.select(column).distinct(), column, name="code", start=1)
