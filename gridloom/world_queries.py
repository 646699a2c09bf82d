"""Queries over files, chunks, containers, registries and typed bytes, each with the DuckDB SQL that it is held against."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import bits, names
from gridloom.operators import codec, filters, heights, hidden, light, merge, neighbours, palette, schema, verify
from gridloom.plans import voxel, world
from gridloom.plans.pipeline import Pipe
from gridloom.queries import LIT, MX, OFF, _opacity, _text, grid, query, table
from gridloom.sources import archive, nbt, packed, region, registry


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one in spark.checkpoint.dir; a temporary one where that is unset and all runs on one machine."""
    top = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if top is None and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = (top or tempfile.gettempdir()).removeprefix("file:").strip("/")
    return f"/{folder}/gridloom-{uuid.uuid4().hex}"


# -- chunks and worlds ---------------------------------------------------------------------------


def chunk_rows(cells: DataFrame, version: int = 2567, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(cx, cz, stamp, data): chunk documents of cells (x, y, z, block), with heights of the kinds asked for (any block counts)."""

    def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        cx, cz = int(pdf["cx"].iloc[0]), int(pdf["cz"].iloc[0])
        out: dict[int, list[str]] = {}
        top = np.zeros(256, np.int32)
        for x, y, z, b in zip(pdf["x"], pdf["y"], pdf["z"], pdf["block"], strict=True):
            out.setdefault(y >> 4, ["air"] * 4096)[(y & 15) << 8 | (z & 15) << 4 | x & 15] = b
            top[(z & 15) << 4 | x & 15] = max(top[(z & 15) << 4 | x & 15], min(y + 1, 511))
        data = region.chunk_document(cx, cz, version, out)
        if kinds:
            name, (kind, root) = nbt.read(data)
            root["Level"] = nbt.COMPOUND, root["Level"][1] | region.height_tags({k: top for k in kinds}, version)
            data = nbt.write((kind, root), name)
        return pd.DataFrame({"cx": [cx], "cz": [cz], "stamp": [cx + 7], "data": [data]})

    own = cells.select(F.floor(F.col("x") / 16).cast("int").alias("cx"), F.floor(F.col("z") / 16).cast("int").alias("cz"), "x", "y", "z", "block")
    return own.groupBy("cx", "cz").applyInPandas(chunk, "cx int, cz int, stamp long, data binary")


def _packed(spark: SparkSession, d: str, preset: str, **more) -> DataFrame:
    """The cells of the grid, packed as a world and unpacked."""
    folder = scratch(spark)
    region.write_files(region.region_files(chunk_rows(grid(spark, d), kinds=("WORLD_SURFACE",))).withColumn("path", F.concat(F.lit("region/"), "path")), f"{folder}/w")
    world.pack(spark, f"{folder}/w", f"{folder}/t", preset, **more)
    return world.unpacked_regions(spark, f"{folder}/t")


def _cells(files: DataFrame) -> DataFrame:
    return region.cells_of(region.section_rows(region.chunks_of(files))).filter("block <> 'air'")


@query("SELECT x, y, z, block FROM voxel", True)
def world_default(spark, d):
    return _cells(_packed(spark, d, "default"))


@query("SELECT x, y, z, CASE block WHEN 'view' THEN 'seen' ELSE block END AS block FROM voxel", True)
def world_fast_renamed(spark, d):
    return _cells(_packed(spark, d, "fast", add_transforms="rename{old=view,new=seen}"))


@query("SELECT x, z, least(max(y) + 1, 511)::INT AS h FROM voxel GROUP BY x, z", True)
def world_smaller_heights(spark, d):
    """Heights that were stripped and come back."""
    rows = region.height_rows(region.chunks_of(_packed(spark, d, "smaller")))
    columns = rows.select("cx", "cz", F.posexplode("heights").alias("i", "h"))
    x, z = F.col("cx") * 16 + F.col("i").bitwiseAND(15), (F.col("cz") * 16 + F.shiftright("i", 4)).cast("long")
    return columns.filter("h > 0").select(x.alias("x"), z.alias("z"), "h")


@query("SELECT DISTINCT k AS kind FROM (VALUES ('WORLD_SURFACE'), ('OCEAN_FLOOR'), ('LEGACY')) t(k)")
def height_kinds(spark, d):
    chunks = chunk_rows(grid(spark, d), kinds=("WORLD_SURFACE", "OCEAN_FLOOR", "LEGACY"))
    return region.height_rows(chunks).select("kind").distinct()


NUMBERS = "CASE block WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 260 WHEN 'error' THEN 17 ELSE 5 END"


@query(f"SELECT x, y, z, ({NUMBERS}) || ':' || light AS block FROM voxel", True)
def legacy_round_trip(spark, d):
    """Cells of old numbers to chunks of old versions and back."""
    cells = grid(spark, d)
    numbered = cells.withColumn("block", F.concat_ws(":", F.expr(NUMBERS), "light"))

    @F.pandas_udf("binary")
    def old(data: pd.Series) -> pd.Series:
        def one(raw: bytes) -> bytes:
            rest, _, found = region.split_chunk(bytes(raw))
            found = [(sy, ["0:0" if s == "air" else s for s in states], ids) for sy, states, ids in found]
            return region.join_chunk(rest, 1343, found)

        return data.map(one)

    chunks = chunk_rows(numbered, 1343).withColumn("data", old("data"))
    return region.cells_of(region.section_rows(chunks)).filter("block <> '0:0'")


@query("SELECT x, y, z, 'm:' || block || '[age=' || light % 4 || ',lit=' || (light > 7) || ']' AS block FROM voxel", True)
def state_from_tags(spark, d):
    """States with properties, through palettes of tags."""
    lit = F.when(F.col("light") > 7, "true").otherwise("false")
    state = names.state_string(F.concat(F.lit("m:"), "block"), F.create_map(F.lit("lit"), lit, F.lit("age"), (F.col("light") % 4).cast("string")))
    return region.cells_of(region.section_rows(chunk_rows(grid(spark, d).withColumn("block", state)))).filter("block <> 'air'")


@query("+c AS (SELECT DISTINCT CAST(floor(x/16) AS INT) AS cx, CAST(floor(z/16) AS INT) AS cz, CAST(floor(y/16) AS INT) AS sy FROM voxel), g AS (SELECT cx, cz, sy, i FROM c CROSS JOIN range(4096) r(i)), j AS (SELECT cx, cz, sy, i, coalesce(block, 'air') AS b FROM g LEFT JOIN voxel v ON v.x = cx * 16 + i % 16 AND v.z = cz * 16 + i // 16 % 16 AND v.y = sy * 16 + i // 256) SELECT cx, cz, sy, sha256(string_agg(b, ',' ORDER BY i)) AS states FROM j GROUP BY 1, 2, 3", True)
def raw_sections(spark, d):
    own = region.section_rows(region.chunks_of(region.region_files(chunk_rows(grid(spark, d)))))
    states = F.transform("ids", lambda i: F.element_at("palette", i + 1))
    return own.select("cx", "cz", "sy", F.sha2(F.array_join(states, ","), 256).alias("states"))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 3000 >= 1976 AND o_orderstatus = 'F' AND o_orderkey % 5 < 2)")
def empty_chunks_of_documents(spark, d):
    """Chunks as documents: their status, version and lists decide."""
    orders = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "noise").otherwise("full").alias("status"))

    @F.pandas_udf("binary")
    def document(status: pd.Series, key: pd.Series) -> pd.Series:
        held = {0: {}, 1: {"PostProcessing": [[], []]}, 2: {"TileEntities": [{"x": 1}]}, 3: {"Structures": {"Starts": {"v": 1}}}, 4: {"ToBeTicked": [[1]]}}
        return pd.Series([nbt.write(nbt.of({"Level": {"Status": s} | held[k % 5]})) for s, k in zip(status, key, strict=True)])

    chunks = orders.select("o_orderkey", document("status", "o_orderkey").alias("rest"), (F.col("o_orderkey") % 3000).cast("int").alias("version"), F.array().alias("sections"))
    return world.not_empty(chunks).select("o_orderkey")


@query("SELECT x, y, z, sym_id FROM (SELECT *, CAST(sym AS INT) AS sym_id FROM voxel JOIN (SELECT block, row_number() OVER (ORDER BY count(*) DESC, block) - 1 AS sym FROM voxel GROUP BY block) USING (block))", True)
def section_codec_round_trip(spark, d):
    cells = grid(spark, d)
    own = palette.remap(cells, palette.palette_by_frequency(cells)).withColumn("region", F.lit(0))
    back = codec.decode_sections(codec.encode_sections(own, "region"), "region")
    return back.select(F.col("x").cast("int").alias("x"), "y", "z", "sym_id")


@query("+h AS (SELECT x, z, coalesce(max(CASE WHEN block IN ('error', 'purchase') THEN y END) + 1, 0) AS h FROM voxel GROUP BY x, z), g AS (SELECT CAST(i % 512 AS INT) AS x, i // 512 AS z FROM range(262144) t(i)) SELECT sha256(unhex('50350A35313220353132203235350A' || string_agg(printf('%02X', coalesce(h, 0) & 255), '' ORDER BY g.z, g.x))) AS sha FROM g LEFT JOIN h ON g.x = h.x AND g.z = h.z", True)
def heightmap_picture(spark, d):
    h = heights.heightmap(grid(spark, d), F.col("block").isin("error", "purchase"))
    plane = voxel.dense_grid(spark, 512, 1, 512).select("x", "z")
    own = plane.join(h, ["x", "z"], "left").select("x", "z", F.coalesce("h", F.lit(0)).alias("h"))
    return voxel.image(own, 512).select(F.sha2("image", 256).alias("sha"))


# -- files, documents, registries ------------------------------------------------------------------


@query("SELECT 'd/' || doc_id % 7 || '/' || doc_id || '.txt' AS path, octet_length(encode(CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END)) AS length, sha256(CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END) AS sha FROM documents")
def folder_round_trip(spark, d):
    """Files written below a folder and scanned, those without bytes too."""
    path = F.concat(F.lit("d/"), F.col("doc_id") % 7, F.lit("/"), "doc_id", F.lit(".txt"))
    files = table(spark, d, "documents").select(path.alias("path"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("text")).cast("binary").alias("content"))
    folder = scratch(spark)
    archive.write(files, folder)
    return archive.scan(spark, folder).select("path", "length", F.sha2("content", 256).alias("sha"))


@query("SELECT doc_id || '.txt' AS path, sha256(text) AS sha FROM documents")
def zip_by_extension(spark, d):
    files = table(spark, d, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    folder = scratch(spark)
    archive.write(files, f"{folder}/all.zip")
    return archive.scan(spark, f"{folder}/all.zip").select("path", F.sha2("content", 256).alias("sha"))


@query("SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def metadata_dropped(spark, d):
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("gridloom/"), "page_id")).otherwise(F.concat(F.lit("gridloomy/"), "page_id"))
    return filters.metadata_dropped(table(spark, d, "pages").select("page_id", path.alias("path")), "gridloom").select("page_id")


@F.pandas_udf(T.BinaryType())
def _gzipped(text: pd.Series) -> pd.Series:
    import json

    return text.map(lambda t: nbt.compressed(nbt.of(json.loads(t))))


@query("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, true AS gz FROM events")
def gzipped_tags(spark, d):
    own = table(spark, d, "events").select("event_id", _gzipped("props").alias("z"))
    return own.select("event_id", F.variant_get(nbt.to_variant(F.col("z")), "$.k", "int").alias("k"), names.is_gzip(F.col("z")).alias("gz"))


@query("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, event_type AS t, user_id AS u FROM events")
def packed_tags(spark, d):
    """Documents of some thousand events packed with a dictionary of their own, and back."""
    own = F.to_json(F.struct(F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"), F.col("event_type").alias("t"), F.col("user_id").alias("u"), F.lit(7).alias("c")))
    documents = table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 4096).cast("int").alias("g"), nbt.from_json(own).alias("data"))
    back = packed.unpack_documents(packed.pack_documents(documents, "g", "event_id"), "event_id").select("event_id", nbt.to_variant(F.col("data")).alias("v"))
    return back.select("event_id", *(schema.extract(F.col("v"), f"$.{k}", t).alias(k) for k, t in (("k", "int"), ("t", "string"), ("u", "long"))))


@query("SELECT event_id, '{' || chr(10) || '  \"k\": ' || regexp_extract(props, '([0-9]+)', 1) || chr(10) || '}' AS text FROM events")
def tag_text(spark, d):
    return table(spark, d, "events").select("event_id", nbt.to_text(nbt.from_json("props")).alias("text"))


@query("SELECT event_id, k, CASE WHEN k % 2 = 0 THEN k::VARCHAR ELSE 'x' || k END AS s, coalesce(CASE WHEN k % 2 = 0 THEN k END, -2) AS as_long, CASE WHEN k % 2 = 0 THEN k ELSE -1 END AS or_default FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)")
def numeric_conversion(spark, d):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    text = F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.lit("x"), k))
    document = F.parse_json(F.to_json(F.struct(k.alias("k"), text.alias("s"))))
    own = table(spark, d, "events").select("event_id", document.alias("v"))
    return own.select("event_id", schema.extract(F.col("v"), "$.k", "long", strict=True).alias("k"), schema.extract(F.col("v"), "$.s", "string").alias("s"), F.coalesce(schema.extract(F.col("v"), "$.s", "long"), F.lit(-2)).alias("as_long"), schema.extract(F.col("v"), "$.s", "long", default=-1).alias("or_default"))


@query("SELECT event_id, event_id % 7 <> 0 AS same FROM events")
def same_documents(spark, d):
    """Documents whose keys stand in another order are the same; those of another value aren't."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    a = F.parse_json(F.concat(F.lit('{"k":'), k, F.lit(',"l":[1]}')))
    b = F.parse_json(F.concat(F.lit('{"l":[1],"k":'), k + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0), F.lit("}")))
    return table(spark, d, "events").select("event_id", verify.same_document(a, b).alias("same"))


RECORDS = "WITH b AS (SELECT p_partkey, ['n' || p_partkey, 'o' || p_partkey] AS names, (p_size % 4 + 1)::INT AS n, p_size FROM part), s AS (SELECT p_partkey, names, n, p_size, unnest(range(n))::INT AS state FROM b)"


@query(f"{RECORDS} SELECT unnest(names) AS name, state, CASE WHEN n % 2 = 0 THEN p_size % 8 ELSE (p_size + state) % 8 END::INT AS flags, (p_size % 16)::INT AS opacity, (state % 16)::INT AS emission, state = n - 1 AS is_default FROM s")
def registry_states(spark, d):
    size, n = F.col("p_size"), (F.col("p_size") % 4 + 1).cast("int")
    each = F.sequence(F.lit(0), n - 1)
    flags = F.when(n % 2 == 0, F.array((size % 8).cast("int"))).otherwise(F.transform(each, lambda i: ((size + i) % 8).cast("int")))
    glow = F.transform(each, lambda i: ((i % 16) * 16 + size % 16).cast("int"))
    blocks = table(spark, d, "part").select(F.array(F.concat(F.lit("n"), "p_partkey"), F.concat(F.lit("o"), "p_partkey")).alias("names"), n.alias("numStates"), (n - 1).alias("defaultStateId"), F.struct(flags.alias("flags"), glow.alias("light")).alias("states"))
    return registry.block_states(blocks)


@query("SELECT (p_partkey * 16 + m)::INT AS state, 'n' || p_partkey AS name, CASE WHEN m < 2 THEN 'v' || m END AS values, (p_size % 8)::INT AS flags, ((p_size + m) % 16)::INT AS opacity, (m % 16)::INT AS emission, m = p_size % 16 AS is_default FROM part CROSS JOIN (SELECT unnest(range(16)) AS m)")
def registry_legacy_states(spark, d):
    size = F.col("p_size")
    glow = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda m: (m * 16 + (size + m) % 16).cast("int"))
    blocks = table(spark, d, "part").select(F.concat(F.lit("n"), "p_partkey").alias("name"), F.col("p_partkey").cast("int").alias("id"), (F.col("p_partkey") * 16 + size % 16).cast("int").alias("defaultStateId"), F.array((size % 8).cast("int")).alias("flags"), glow.alias("light"), F.array(F.lit("v0"), F.lit("v1")).alias("states"))
    return registry.legacy_states(blocks)


@query("SELECT (p_size * 10)::INT AS v, 'a' || p_partkey AS old, 'b' || p_partkey AS new FROM part UNION ALL SELECT (p_size * 10)::INT, 'c' || p_partkey, 'd' || p_partkey FROM part")
def registry_renames(spark, d):
    def name(x: str) -> Column:
        return F.concat(F.lit(x), "p_partkey")

    records = table(spark, d, "part").select((F.col("p_size") * 10).cast("int").alias("version"), F.create_map(name("a"), name("b"), name("c"), name("d")).alias("renames"))
    return registry.renames(records)


@query("SELECT c_custkey, n_name, c_nationkey AS back FROM customer JOIN nation ON c_nationkey = n_nationkey")
def both_ways(spark, d):
    by_id, by_name = merge.both_ways(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", "n_name")
    own = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(by_id, "n_nationkey").drop("n_nationkey")
    return own.join(by_name, "n_name").select("c_custkey", "n_name", F.col("n_nationkey").alias("back"))


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_type)::INT AS code FROM part")
def shape_lookup(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.split("p_type", " ").alias("parts"), "p_type")
    shapes = palette.dictionary(parts, "p_type").select("code", F.split("p_type", " ").alias("own"))
    return schema.shape_lookup(parts, F.col("parts"), shapes, F.col("own")).select("p_partkey", "code")


# -- statistics ------------------------------------------------------------------------------------


@query(f"+{MX}, h AS (SELECT block, mn - light AS bin, count(*) AS n FROM mx WHERE mn > 0 AND light < mn GROUP BY 1, 2), s AS (SELECT block, (15 - light % 4) AS bin, 16 * count(*) AS n FROM voxel WHERE light % 4 > 0 GROUP BY 1, 2), w AS (SELECT block, bin, sum(n) AS n FROM (SELECT * FROM h UNION ALL SELECT * FROM s) GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY block) AS samples FROM w) SELECT block, max(CASE WHEN n > floor(samples / 12) THEN bin END)::INT AS opacity FROM t GROUP BY block", True)
def opacity_of_both_lights(spark, d):
    """Block light counts once, sky light sixteen times."""
    cells = grid(spark, d)
    lamps = neighbours.opacity_histogram(neighbours.brightest_neighbour(cells))
    sky = neighbours.opacity_histogram(cells.withColumn("mn", F.lit(15)).withColumn("light", F.col("light") % 4).filter("light > 0"), weight=16)
    own = lamps.unionByName(sky).groupBy("block", "bin").agg(F.sum("n").alias("n"))
    return neighbours.opacity_estimate(own).select("block", F.col("opacity").cast("int").alias("opacity"))


@query("+s AS (SELECT count(*) AS n, greatest(4, length(bin(CAST(count(DISTINCT block) - 1 AS BIGINT)))) AS b FROM voxel GROUP BY floor(x/16), floor(z/16), floor(y/16)) SELECT round(sum(n * b) / sum(n), 6) AS bits_per_block, CAST(sum(n) AS BIGINT) AS n_blocks FROM s", True)
def bits_per_block(spark, d):
    own = voxel.sections(grid(spark, d))
    return verify.bits_per_block(own.withColumn("b", F.col("bits") * F.col("n_blocks")), "b", "n_blocks")


@query("SELECT count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents")
def progress(spark, d):
    rows, seen = verify.progress(table(spark, d, "documents").select("doc_id", "n_chars"), "seen", "n_chars")
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"], seen.get["bytes"])], "rows long, bytes long")


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS none, o_orderkey % 4 <> 1 AS inner_none, o_orderkey % 5 <> 2 AS no_starts FROM orders")
def list_helpers(spark, d):
    k = F.col("o_orderkey")
    ints = F.when(k % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    nested = F.when(k % 4 == 0, F.lit(None).cast("array<array<int>>")).when(k % 4 == 1, F.array(F.array(F.lit(1)))).otherwise(F.array(F.array().cast("array<int>")))
    starts = F.when(k % 5 == 2, F.create_map(F.lit("a"), F.lit(1))).otherwise(F.create_map(F.lit("a"), F.lit(None).cast("int")))
    return table(spark, d, "orders").select("o_orderkey", filters.list_empty(ints).alias("none"), filters.nested_empty(nested).alias("inner_none"), filters.structures_empty(starts).alias("no_starts"))


@query("SELECT o_custkey, min(o_orderkey) AS least, count(*) FILTER (WHERE o_orderkey < 30000) AS below FROM orders GROUP BY 1")
def lower_bound(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("v"))
    return lists.select("o_custkey", F.get("v", F.lit(0)).alias("least"), merge.lower_bound(F.col("v"), F.lit(30000)).cast("long").alias("below"))


@query("SELECT coalesce((SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 ORDER BY o_orderdate, o_orderkey LIMIT 1), -1) AS o_orderkey UNION ALL SELECT -1")
def first_or_default(spark, d):
    orders = table(spark, d, "orders")
    some, none = (merge.first_or_default(orders, F.col("o_totalprice") > least, "o_orderkey", "o_orderdate", "o_orderkey", default=-1) for least in (200000, 10**9))
    return some.union(none)


# -- light -----------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE voxel AS (SELECT CAST(event_id % 32 AS INT) AS x, CAST(floor(event_id / 32) AS BIGINT) % 32 AS z, CAST(floor(event_id / 1024) AS BIGINT) AS y, event_type AS block, CAST(floor(value) AS INT) % 16 AS light FROM events), {LIT}, s AS (SELECT x, y, z, max(l) AS l FROM (SELECT x, y, z, emit AS l FROM a WHERE x < 16 AND emit > 0 UNION ALL SELECT x, y, z, light FROM voxel WHERE x = 15 AND light > 0) GROUP BY 1, 2, 3), r(x, y, z, lvl) AS (SELECT x, y, z, l FROM s UNION SELECT n.x, n.y, n.z, r.lvl - n.op FROM r CROSS JOIN off JOIN a n ON n.x < 16 AND n.x = r.x + dx AND n.y = r.y + dy AND n.z = r.z + dz WHERE r.lvl - n.op > 0) SELECT x, y, z, max(lvl) AS lvl FROM r GROUP BY x, y, z")
def light_from_borders(spark, d):
    """One half of the grid, lit by its own cells and by what is stored for its border."""
    cells = grid(spark, d).filter("x < 16")
    seeds = cells.filter((F.col("block") == "error") & (F.col("light") >= 8)).select("x", "y", "z", F.col("light").alias("lvl"))
    borders = cells.filter("x = 15").select("x", "y", "z", F.col("light").alias("lvl"))
    return light.propagate(light.with_border_light(seeds, borders), cells.select("x", "y", "z", _opacity().alias("op")))


@query("SELECT x, y, z, CASE WHEN light % 3 = 0 THEN light ELSE 0 END - CASE WHEN light % 2 = 0 THEN light ELSE 0 END AS delta FROM voxel WHERE delta <> 0", True)
def light_delta(spark, d):
    cells = grid(spark, d).select("x", "y", "z", F.col("light").alias("lvl"))
    return light.light_delta(cells.filter("lvl % 3 = 0"), cells.filter("lvl % 2 = 0"))


# -- pipes and functions ---------------------------------------------------------------------------


@query("SELECT x, y, z, block, light FROM voxel", True)
def pipe_reversed(spark, d):
    pipe = Pipe.parse("rename{old=view,new=seen}") + Pipe.parse("sort_palette")
    return pipe.reverse(pipe.apply(grid(spark, d)))


@query("+v AS (SELECT *, CASE block WHEN 'view' THEN 'seen' ELSE block END AS b FROM voxel), p AS (SELECT b, row_number() OVER (ORDER BY count(*) DESC, b) - 1 AS sym FROM v GROUP BY b) SELECT x, y, z, v.b AS block, sym::INT AS sym_id FROM v JOIN p ON p.b = v.b", True)
def pipe_joined(spark, d):
    pipe = Pipe.parse("rename{old=view,new=seen}") + Pipe.parse("sort_palette")
    return pipe.apply(grid(spark, d)).select("x", "y", "z", "block", "sym_id")


@query(f"+{OFF}, nb AS (SELECT v.x, v.y, v.z, n.block FROM voxel v CROSS JOIN off LEFT JOIN voxel n ON n.x = v.x + dx AND n.y = v.y + dy AND n.z = v.z + dz) SELECT x, y, z, count(block) AS n, count(block) = 6 AND count(*) FILTER (WHERE block = 'view') = 0 AS hidden FROM nb GROUP BY 1, 2, 3", True)
def hidden_flags(spark, d):
    """How many of the six touching cells are there, and whether they hide the cell."""
    near = neighbours.with_neighbours(grid(spark, d), "block", F.lit(None).cast("string"), hidden.SIX)
    there = F.filter("near", lambda b: b.isNotNull())
    return near.select("x", "y", "z", F.size(there).cast("long").alias("n"), ((F.size(there) == 6) & ~F.array_contains(there, "view")).alias("hidden"))


@query("SELECT p_partkey, printf('%08X', p_partkey) AS big, substr(printf('%08X', p_partkey), 7, 2) || substr(printf('%08X', p_partkey), 5, 2) || substr(printf('%08X', p_partkey), 3, 2) || substr(printf('%08X', p_partkey), 1, 2) AS little, p_partkey::BIGINT AS a, p_partkey::BIGINT AS b, (p_size - 25)::BIGINT AS c, ((p_size - 25 + 256) % 256)::BIGINT AS d, p_name AS name FROM part")
def typed_memory(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size") - 25
    memory = F.concat(bits.number_bytes(p, "u32"), bits.number_bytes(p, "i32", little=True), bits.number_bytes(s, "i16", little=True), bits.number_bytes(s, "i8"), bits.text_bytes(F.col("p_name")))
    own = table(spark, d, "part").select("p_partkey", "p_name", memory.alias("m"))
    m = F.col("m")
    return own.select(
        "p_partkey", F.hex(F.substring(m, 1, 4)).alias("big"), F.hex(F.substring(m, 5, 4)).alias("little"), bits.read_number(m, F.lit(0), "u32").alias("a"), bits.read_number(m, F.lit(4), "i32", little=True).alias("b"),
        bits.read_number(m, F.lit(8), "i16", little=True).alias("c"), bits.read_number(m, F.lit(10), "u8").alias("d"), bits.read_text(m, F.lit(11)).alias("name"),
    )


@query("SELECT o_custkey, count(DISTINCT day(o_orderdate)) AS n, bool_or(day(o_orderdate) = 5) AS has5, coalesce(min(CASE WHEN day(o_orderdate) >= 10 THEN day(o_orderdate) END), -1)::INT AS next10, count(DISTINCT day(o_orderdate)) = 32 AS every FROM orders GROUP BY 1")
def bitsets(spark, d):
    days = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.dayofmonth("o_orderdate")).alias("v")).select("o_custkey", bits.bitset(F.col("v"), 32).alias("w"))
    w = F.col("w")
    return days.select("o_custkey", bits.bitset_count(w).cast("long").alias("n"), bits.bitset_has(w, F.lit(5)).alias("has5"), bits.bitset_next(w, F.lit(10)).cast("int").alias("next10"), bits.bitset_all(w, 32).alias("every"))


@query("SELECT o_orderkey, o_custkey::BIGINT AS a, (o_orderkey % 512)::BIGINT AS b, (o_custkey % 2)::BIGINT AS c FROM orders")
def bit_stream(spark, d):
    """Numbers of 40, 9 and 1 bits in one string of bits and back."""
    values = F.array(F.col("o_custkey").cast("long"), F.col("o_orderkey") % 512, F.col("o_custkey") % 2)
    widths = F.array(*(F.lit(n) for n in (40, 9, 1)))
    own = table(spark, d, "orders").select("o_orderkey", bits.bits_write(values, widths).alias("s"), widths.alias("w"))
    back = own.select("o_orderkey", bits.bits_read("s", "w").alias("v"))
    return back.select("o_orderkey", *(F.get("v", F.lit(i)).alias(k) for i, k in enumerate("abc")))


@query("SELECT o_custkey, string_agg(2 * v + i - 1, ',' ORDER BY i) AS seen FROM (SELECT o_custkey, o_orderkey % 100 AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) GROUP BY 1")
def visited(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda v: v % 100).alias("v"))
    return lists.select("o_custkey", _text(bits.visit(F.col("v"), lambda v, i: 2 * v + i, "short")).alias("seen"))


@query("SELECT page_id, lower(url) = 'x' AS same, starts_with(lower(url), 'http') AS starts, ends_with(lower(url), '.html') AS ends, contains(lower(url), 'example') AS holds FROM pages")
def case_insensitive(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", names.equals_ci(url, "X").alias("same"), names.starts_with_ci(url, "HTTP").alias("starts"), names.ends_with_ci(url, ".Html").alias("ends"), names.contains_ci(url, "EXAMPLE").alias("holds"))


@query("SELECT p_partkey, least(p_size, 25)::INT AS lo, greatest(p_size, 25)::INT AS hi, abs(p_size - 25)::INT AS size, sign(p_size - 25)::INT AS sign FROM part")
def min_max_sign(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.least(s, F.lit(25)).cast("int").alias("lo"), F.greatest(s, F.lit(25)).cast("int").alias("hi"), F.abs(s - 25).cast("int").alias("size"), F.signum(s - 25).cast("int").alias("sign"))
