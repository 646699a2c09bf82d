"""Grid views of tables: cells in long form, one row for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The voxel view of ``events`` in DuckDB's SQL, for queries that are held against it.
VOXEL_SQL = "voxel AS (SELECT CAST(event_id % 32 AS INT) AS x, CAST(floor(event_id / 32) AS BIGINT) % 32 AS z, CAST(floor(event_id / 1024) AS BIGINT) AS y, event_type AS block, CAST(floor(value) AS INT) % 16 AS light FROM events)"


def voxels(events: DataFrame) -> DataFrame:
    """(x int, z long, y long, block, light int): cells of a grid of 32 by 32 columns, x fastest, then z, then y."""
    e = F.col("event_id")
    return events.select((e % 32).cast("int").alias("x"), (F.floor(e / 32) % 32).cast("long").alias("z"), F.floor(e / 1024).cast("long").alias("y"), F.col("event_type").alias("block"), (F.floor("value").cast("int") % 16).cast("int").alias("light"))


def sections(cells: DataFrame, air: str | None = None) -> DataFrame:
    """(cx, cz, sy, n_blocks, palette_len, bits) of each section of 16 cells a side; sections of ``air`` alone are left out."""
    from gridloom.functions.bits import palette_bits

    key = [F.floor(F.col("x") / 16).cast("int").alias("cx"), F.floor(F.col("z") / 16).cast("int").alias("cz"), F.floor(F.col("y") / 16).cast("long").alias("sy")]
    # distinct blocks first: a count of each, then their number
    each = cells.groupBy(*key, "block").agg(F.count("*").alias("n"))
    out = each.groupBy("cx", "cz", "sy").agg(F.sum("n").alias("n_blocks"), F.count("block").alias("palette_len"), F.max(F.col("block") if air is None else F.when(F.col("block") != air, F.col("block"))).alias("_any"))
    if air is not None:
        out = out.filter(F.col("_any").isNotNull())
    return out.select("cx", "cz", "sy", "n_blocks", "palette_len", palette_bits(F.col("palette_len")).alias("bits"))


def extents(cells: DataFrame) -> DataFrame:
    """(min_sy, max_sy) over sections that have cells."""
    return cells.agg(F.floor(F.min("y") / 16).cast("long").alias("min_sy"), F.floor(F.max("y") / 16).cast("long").alias("max_sy"))


def section_rows(cells: DataFrame) -> int:
    """How many sections high a grid from 0 must be to hold all cells; 0 without cells."""
    top = extents(cells).first()["max_sy"]
    return 0 if top is None else top + 1


def dense_grid(spark, nx: int, ny: int, nz: int) -> DataFrame:
    """All (x, y, z) of a grid that starts at 0, made from one range."""
    i = F.col("id")
    return spark.range(nx * ny * nz).select((i % nx).cast("int").alias("x"), F.floor(i / (nx * nz)).cast("long").alias("y"), (F.floor(i / nx) % nz).cast("long").alias("z"))


def dense_dump(cells: DataFrame, palette: DataFrame, nx: int, ny: int, nz: int) -> DataFrame:
    """(index, sym_id) of every cell of a grid, those without a block as 0 (palette: block, sym_id)."""
    grid = dense_grid(cells.sparkSession, nx, ny, nz)
    own = cells.join(palette, "block").select("x", "y", "z", "sym_id")
    return grid.join(own, ["x", "y", "z"], "left").select(((F.col("y") * nz + F.col("z")) * nx + F.col("x")).cast("long").alias("index"), F.coalesce("sym_id", F.lit(0)).cast("int").alias("sym_id"))


def image(plane: DataFrame, side: int, value: str = "h") -> DataFrame:
    """(image): a grey picture (PGM) of the values, from 0 to 255, of a whole plane (x, z) of ``side`` by ``side``; a bounded one."""
    byte = F.unhex(F.lpad(F.hex(F.col(value).cast("long").bitwiseAND(255)), 2, "0"))
    rows = plane.groupBy("z").agg(F.array_sort(F.collect_list(F.struct("x", byte.alias("b")))).alias("row"))
    rows = rows.select("z", F.aggregate("row", F.lit(b""), lambda a, s: F.concat(a, s["b"])).alias("row"))
    whole = rows.agg(F.array_sort(F.collect_list(F.struct("z", "row"))).alias("all"))
    return whole.select(F.concat(F.lit(f"P5\n{side} {side} 255\n".encode()), F.aggregate("all", F.lit(b""), lambda a, s: F.concat(a, s["row"]))).alias("image"))


def section_arrays(cells: DataFrame, palette: DataFrame) -> DataFrame:
    """(cx, cz, sy, blocks): the ids of each section by the places of its cells (4,096 at most)."""
    from gridloom.functions.geometry import cell_index

    own = cells.join(palette, "block").select(F.floor(F.col("x") / 16).cast("int").alias("cx"), F.floor(F.col("z") / 16).cast("int").alias("cz"), F.floor(F.col("y") / 16).cast("long").alias("sy"), cell_index(F.col("x").cast("int"), F.col("y").cast("int"), F.col("z").cast("int")).alias("i"), "sym_id")
    return own.groupBy("cx", "cz", "sy").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "sym_id"))), lambda s: s["sym_id"]).alias("blocks"))


def presence(cells: DataFrame, nx: int, ny: int, nz: int) -> DataFrame:
    """(cx, cz, sy, present) of every section of a grid of so many sections."""
    grid = dense_grid(cells.sparkSession, nx, ny, nz).select(F.col("x").alias("cx"), F.col("z").cast("int").alias("cz"), F.col("y").cast("int").alias("sy"))
    own = cells.select(F.floor(F.col("x") / 16).cast("int").alias("cx"), F.floor(F.col("z") / 16).cast("int").alias("cz"), F.floor(F.col("y") / 16).cast("int").alias("sy")).distinct().withColumn("present", F.lit(True))
    return grid.join(own, ["cx", "cz", "sy"], "left").select("cx", "cz", "sy", F.coalesce("present", F.lit(False)).alias("present"))
