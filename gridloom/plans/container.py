"""A grid at rest: one Parquet table for each part, by region; derived parts may be left out and computed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.heights import deltas, heightmap, undo_deltas
from gridloom.operators.light import propagate
from gridloom.operators.palette import palette_by_frequency, remap


def _region() -> tuple[Column, Column]:
    return F.floor(F.col("x") / 512).cast("int").alias("rx"), F.floor(F.col("z") / 512).cast("int").alias("rz")


def write(cells: DataFrame, path: str, opaque: Column, heights: DataFrame | None = None, light: DataFrame | None = None, height_mode: str = "delta") -> None:
    """Parts: palette, blocks (ids by region), heights (strip: none; delta: only columns that differ from the computed; keep), light (if given)."""
    palette = palette_by_frequency(cells)
    palette.write.mode("overwrite").parquet(f"{path}/palette")
    remap(cells, palette).select(*_region(), "x", "y", "z", "sym_id").write.mode("overwrite").partitionBy("rx", "rz").parquet(f"{path}/blocks")
    if heights is not None and height_mode != "strip":
        own = heights.select("x", "z", "h")
        if height_mode == "delta":
            own = deltas(own, heightmap(cells, opaque), ["x", "z"], "h").filter("delta <> 0")
        own.write.mode("overwrite").parquet(f"{path}/heights")
    if light is not None:
        light.select("x", "y", "z", "lvl").write.mode("overwrite").parquet(f"{path}/light")


def read_cells(spark: SparkSession, path: str, rx: int | None = None, rz: int | None = None) -> DataFrame:
    """(x, y, z, block), of one region if asked: only its folder is read."""
    blocks = spark.read.parquet(f"{path}/blocks")
    if rx is not None:
        blocks = blocks.filter((F.col("rx") == rx) & (F.col("rz") == rz))
    return blocks.join(spark.read.parquet(f"{path}/palette").select("block", "sym_id"), "sym_id").select("x", "y", "z", "block")


def read_heights(spark: SparkSession, path: str, opaque: Column, height_mode: str = "delta") -> DataFrame:
    """(x, z, h): stored, computed, or computed and corrected."""
    if height_mode == "keep":
        return spark.read.parquet(f"{path}/heights")
    computed = heightmap(read_cells(spark, path), opaque)
    if height_mode == "strip":
        return computed
    off = spark.read.parquet(f"{path}/heights")
    whole = computed.select("x", "z").join(off, ["x", "z"], "left").select("x", "z", F.coalesce("delta", F.lit(0)).alias("delta"))
    return undo_deltas(whole, computed, ["x", "z"], "h")


def read_light(spark: SparkSession, path: str, seeds, opacity, stored: bool = True) -> DataFrame:
    """(x, y, z, lvl): stored, or spread anew from functions of the cells that give seeds and opacity."""
    if stored:
        return spark.read.parquet(f"{path}/light")
    cells = read_cells(spark, path)
    return propagate(seeds(cells), opacity(cells))
