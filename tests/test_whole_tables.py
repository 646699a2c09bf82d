"""Queries over tables that are higher or longer than the driver's smallest: every row counts."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries over worlds too
from gridloom import queries as q
from gridloom.operators import codec
from gridloom.plans import voxel


def events(spark, path, n):
    kinds = F.array(*map(F.lit, ("view", "click", "error", "purchase")))
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.element_at(kinds, (F.col("id") * F.col("id") % 7 % 4 + 1).cast("int")).alias("event_type"), (F.col("id") % 13).cast("double").alias("value"))
    rows.write.parquet(f"{path}/events.parquet")
    return voxel.voxels(rows)


def test_codec_round_trip(spark, tmp_path):
    cells = events(spark, tmp_path, 3000)
    got = q.QUERIES["codec_round_trip"](spark, str(tmp_path)).collect()
    ids = {r.block: k for k, r in enumerate(cells.groupBy("block").count().orderBy(F.desc("count"), "block").collect())}
    assert sorted((r.x, r.y, r.z, r.sym_id) for r in got) == sorted((r.x, r.y, r.z, ids[r.block]) for r in cells.collect())


def test_durations(spark, tmp_path):
    spark.createDataFrame([(59,), (359999,), (360000,), (3600000 * 5 + 61,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.t for r in q.QUERIES["durations"](spark, str(tmp_path)).collect()}
    assert got == {59: "59s", 359999: "99h 59m 59s", 360000: "100h 0m 0s", 18000061: "5000h 1m 1s"}


def test_dense_dump(spark, tmp_path):
    cells = events(spark, tmp_path, 40000)
    got = {r["index"]: r.sym_id for r in q.QUERIES["dense_dump"](spark, str(tmp_path)).collect()}
    ids = {r.block: k for k, r in enumerate(cells.groupBy("block").count().orderBy(F.desc("count"), "block").collect())}
    assert sorted(got) == list(range(32 * 32 * 48))
    assert all(got.pop((r.y * 32 + r.z) * 32 + r.x) == ids[r.block] for r in cells.collect())
    assert set(got.values()) == {0}


def test_presence_grid(spark, tmp_path):
    events(spark, tmp_path, 32 * 1024 + 1)
    got = {(r.cx, r.cz, r.sy): r.present for r in q.QUERIES["presence_grid"](spark, str(tmp_path)).collect()}
    assert got == {(x, z, y): y < 2 or x == z == 0 for x in (0, 1) for z in (0, 1) for y in range(3)}


@pytest.mark.parametrize("name", ["raw_sections", "state_from_tags", "world_default", "legacy_round_trip", "region_round_trip", "world_fast_renamed"])
def test_sections_above_a_byte(spark, tmp_path, name):
    """Heights of sections that the format's byte can't hold."""
    ids = [1024 * y + k for y in (0, 16 * 127 + 15, 16 * 128, 16 * 255 + 3, 16 * 256, 5859) for k in (0, 17, 1023)]
    kinds = F.array(*map(F.lit, ("view", "click", "error", "purchase")))
    rows = spark.createDataFrame([(i,) for i in ids], "event_id long").select("event_id", F.get(kinds, (F.col("event_id") % 4).cast("int")).alias("event_type"), (F.col("event_id") % 13).cast("double").alias("value"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(q.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(q.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()) == sorted(want.fetchall())


def test_world_default_far_apart(spark, tmp_path):
    """Keys with wide gaps: what lies between sections takes no memory."""
    ids = [k * 1_000_000_007 + i for k in (0, 1, 59) for i in (0, 1023, 1024, 16400)]
    rows = spark.createDataFrame([(i, ("view", "click", "error", "purchase")[i % 4], float(i % 13)) for i in ids], "event_id long, event_type string, value double")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = q.QUERIES["world_default"](spark, str(tmp_path)).select("x", "y", "z", "block").collect()
    assert sorted(got) == sorted(voxel.voxels(rows).select("x", "y", "z", "block").collect())


def test_code_of_far_sections(spark):
    """Closed gaps leave the code as it is over the whole grid, and every cell comes back to its place."""
    near = ((-1, 0, 0), (0, -1, 0), (0, -20, 0), (-17, 0, 2))
    rows = [("r", x, y, z, 1 + (x * 7 + y * 5 + z * 3) % 6) for x in (3, 18, 19, 20, 400) for y in (-70, -3, 0, 17, 18, 37, 900) for z in (5, 6, 90)]
    coded = codec.encode_regions(spark.createDataFrame(rows, "region string, x int, y long, z long, sym_id int"), "region", context_bits=6, neighbours=near)
    r = coded.first()
    assert (r.nx, r.ny, r.nz, r.x0, r.y0, r.z0) == (398, 971, 86, 3, -70, 5)
    grid, mask = np.zeros((r.ny, r.nz, r.nx), np.int32), np.zeros((r.ny, r.nz, r.nx), bool)
    for s in r.sections:
        mask[tuple(slice(max(0, c * 16 - a), max(0, c * 16 + 16 - a)) for c, a in ((s.cy, r.y0), (s.cz, r.z0), (s.cx, r.x0)))] = True
    for _, x, y, z, i in rows:
        grid[y - r.y0, z - r.z0, x - r.x0] = i
    assert codec.GridCodec(r.palette, 6, near).encode(grid, mask) == bytes(r.payload)
    assert sorted(tuple(c) for c in codec.decode_regions(coded, "region").filter("sym_id > 0").collect()) == sorted(rows)
