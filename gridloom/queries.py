"""The library's own queries over the driver's tables, each with the DuckDB SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import bits, geometry, names
from gridloom.operators import bundle, codec, filters, heights, hidden, light, merge, neighbours, palette, schema, verify
from gridloom.plans import materials, voxel
from gridloom.plans.pipeline import Pipe
from gridloom.plans.voxel import VOXEL_SQL
from gridloom.sources import archive, nbt, region

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, cells: bool = False):
    """Registers a function; ``cells``: its SQL may use the view voxel."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {VOXEL_SQL}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().lstrip('+')}" if cells else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel.voxels(table(spark, sf_dir, "events"))


def _text(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), ",")


def opaque() -> Column:
    return F.col("block").isin("error", "purchase")


OFF = "off(dx, dy, dz) AS (VALUES (-1,0,0),(1,0,0),(0,-1,0),(0,1,0),(0,0,-1),(0,0,1))"
MX = f"{OFF}, mx AS (SELECT v.x, v.y, v.z, v.block, v.light, max(coalesce(n.light, 0)) AS mn FROM voxel v CROSS JOIN off LEFT JOIN voxel n ON n.x = v.x + dx AND n.y = v.y + dy AND n.z = v.z + dz GROUP BY ALL)"

# -- palettes, statistics of columns ------------------------------------------------------------


@query("SELECT event_type, n, CAST(row_number() OVER (ORDER BY n DESC, event_type) - 1 AS INT) AS sym_id FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def palette_by_frequency(spark, d):
    return palette.palette_by_frequency(table(spark, d, "events"), "event_type")


@query("SELECT event_type, first, CAST(row_number() OVER (ORDER BY first) - 1 AS INT) AS sym_id FROM (SELECT event_type, min(event_id) AS first FROM events GROUP BY 1)")
def palette_first_seen(spark, d):
    return palette.checked_palette(palette.palette_first_seen(table(spark, d, "events"), "event_type", "event_id"))


@query("+p AS (SELECT block, CAST(row_number() OVER (ORDER BY count(*) DESC, block) - 1 AS INT) AS sym_id FROM voxel GROUP BY block) SELECT x, y, z, sym_id FROM voxel JOIN p USING (block)", True)
def palette_remap(spark, d):
    cells = grid(spark, d)
    return palette.remap(cells, palette.palette_by_frequency(cells)).select("x", "y", "z", "sym_id")


@query("SELECT event_type || ':' || props AS str, count(*) AS freq FROM events GROUP BY 1 HAVING count(*) > 1 ORDER BY freq DESC, str LIMIT 256")
def string_pool_top256(spark, d):
    return palette.string_pool(table(spark, d, "events").select(F.concat_ws(":", "event_type", "props").alias("str")), "str")


@query("SELECT p_brand, p_size, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS names FROM part GROUP BY ALL")
def grouped_names(spark, d):
    return palette.grouped_names(table(spark, d, "part"), "p_type", ["p_brand", "p_size"]).withColumn("names", F.array_join("names", ","))


@query("SELECT o_custkey, array_to_string(CASE WHEN len(list_distinct(a)) = 1 THEN a[1:1] ELSE a END, ',') AS v FROM (SELECT o_custkey, list(o_orderstatus ORDER BY o_orderkey) AS a FROM orders GROUP BY 1)")
def collapse_constant(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda s: s["o_orderstatus"]).alias("a"))
    return lists.select("o_custkey", F.array_join(palette.collapse_constant(F.col("a")), ",").alias("v"))


@query("SELECT p_type, row_number() OVER (ORDER BY p_type)::INT AS code FROM (SELECT DISTINCT p_type FROM part)")
def shape_dictionary(spark, d):
    return palette.dictionary(table(spark, d, "part"), "p_type")


@query("SELECT cast(floor(x/16) AS INT) AS cx, cast(floor(z/16) AS INT) AS cz, cast(floor(y/16) AS BIGINT) AS sy, count(*) AS n_blocks, count(DISTINCT block) AS palette_len, CAST(greatest(4, length(bin(CAST(count(DISTINCT block) - 1 AS BIGINT)))) AS INT) AS bits FROM voxel GROUP BY 1, 2, 3", True)
def sections(spark, d):
    return voxel.sections(grid(spark, d))


@query("SELECT cast(floor(x/16) AS INT) AS cx, cast(floor(z/16) AS INT) AS cz, cast(floor(y/16) AS BIGINT) AS sy, count(*) AS n_blocks, count(DISTINCT block) AS palette_len, CAST(greatest(4, length(bin(CAST(count(DISTINCT block) - 1 AS BIGINT)))) AS INT) AS bits FROM voxel GROUP BY 1, 2, 3 HAVING NOT (count(DISTINCT block) = 1 AND min(block) = 'view')", True)
def sections_not_air(spark, d):
    return voxel.sections(grid(spark, d), air="view")


@query("SELECT CAST(floor(min(y)/16) AS BIGINT) AS min_sy, CAST(floor(max(y)/16) AS BIGINT) AS max_sy FROM voxel", True)
def extents(spark, d):
    return voxel.extents(grid(spark, d))


@query("+g AS (SELECT * FROM (VALUES (0),(1)) a(cx) CROSS JOIN (VALUES (0),(1)) b(cz) CROSS JOIN (SELECT unnest(range(greatest(1, max(y) // 16 + 1)))::INT AS sy FROM voxel) c), p AS (SELECT DISTINCT CAST(floor(x/16) AS INT) AS cx, CAST(floor(z/16) AS INT) AS cz, CAST(floor(y/16) AS INT) AS sy FROM voxel) SELECT g.cx, g.cz, g.sy, p.cx IS NOT NULL AS present FROM g LEFT JOIN p ON g.cx = p.cx AND g.cz = p.cz AND g.sy = p.sy", True)
def presence_grid(spark, d):
    cells = grid(spark, d)
    return voxel.presence(cells, 2, max(1, voxel.section_rows(cells)), 2)


@query("+p AS (SELECT block, CAST(row_number() OVER (ORDER BY count(*) DESC, block) - 1 AS INT) AS sym_id FROM voxel GROUP BY block), g AS (SELECT i AS index, CAST(i % 32 AS INT) AS x, (i // 32) % 32 AS z, i // 1024 AS y FROM (SELECT unnest(range(greatest(1, max(y) // 16 + 1) * 16384)) AS i FROM voxel)) SELECT index, coalesce(sym_id, 0) AS sym_id FROM g LEFT JOIN (SELECT x, y, z, sym_id FROM voxel JOIN p USING (block)) v ON g.x = v.x AND g.y = v.y AND g.z = v.z", True)
def dense_dump(spark, d):
    cells = grid(spark, d)
    return voxel.dense_dump(cells, palette.palette_by_frequency(cells), 32, 16 * max(1, voxel.section_rows(cells)), 32)


@query("+p AS (SELECT block, CAST(row_number() OVER (ORDER BY count(*) DESC, block) - 1 AS INT) AS sym_id FROM voxel GROUP BY block) SELECT CAST(floor(x/16) AS INT) AS cx, CAST(floor(z/16) AS INT) AS cz, CAST(floor(y/16) AS BIGINT) AS sy, sha256(string_agg(sym_id::VARCHAR, ',' ORDER BY (y % 16) * 256 + (z % 16) * 16 + x % 16)) AS ids FROM voxel JOIN p USING (block) GROUP BY 1, 2, 3", True)
def section_arrays(spark, d):
    cells = grid(spark, d)
    own = voxel.section_arrays(cells, palette.palette_by_frequency(cells))
    return own.select("cx", "cz", "sy", F.sha2(F.array_join(F.transform("blocks", lambda b: b.cast("string")), ","), 256).alias("ids"))


@query("SELECT o_custkey, bit_or((1::BIGINT << (month(o_orderdate) - 1))) AS mask FROM orders GROUP BY 1")
def kind_bitmap(spark, d):
    return heights.known_kinds(table(spark, d, "orders"), "o_custkey", F.month("o_orderdate") - 1)


# -- columns and heights ------------------------------------------------------------------------


@query("SELECT user_id, coalesce(max(CASE WHEN event_type <> 'error' THEN event_id END) + 1, 0) AS height FROM events GROUP BY user_id")
def column_top(spark, d):
    return heights.column_top(table(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") != "error")


@query("WITH g AS (SELECT user_id, max(event_id) + 1 AS actual, coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END) + 1, 0) AS pred FROM events GROUP BY 1) SELECT user_id, actual - pred AS delta FROM g")
def column_delta(spark, d):
    events = table(spark, d, "events")
    return heights.deltas(heights.column_top(events, ["user_id"], "event_id", F.lit(True)), heights.column_top(events, ["user_id"], "event_id", F.col("event_type") == "purchase"), ["user_id"])


@query("SELECT user_id, max(event_id) + 1 AS height FROM events GROUP BY 1")
def column_delta_undone(spark, d):
    predicted = heights.column_top(table(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") == "purchase")
    return heights.undo_deltas(column_delta(spark, d), predicted, ["user_id"])


@query("SELECT x, z, coalesce(max(CASE WHEN block IN ('error', 'purchase') THEN y END) + 1, 0) AS h FROM voxel GROUP BY x, z", True)
def heightmap(spark, d):
    return heights.heightmap(grid(spark, d), opaque())


@query("+h AS (SELECT x, z, max(CASE WHEN block IN ('error', 'purchase') THEN y END) + 1 AS h FROM voxel GROUP BY x, z) SELECT v.block, count(*) AS hits FROM h JOIN voxel v ON v.x = h.x AND v.z = h.z AND v.y = h.h - 1 GROUP BY 1", True)
def height_opaque_estimate(spark, d):
    cells = grid(spark, d)
    return heights.top_blocks(cells, heights.heightmap(cells, opaque()))


@query("+h AS (SELECT x, z, coalesce(max(CASE WHEN block IN ('error', 'purchase') THEN y END) + 1, 0) AS h FROM voxel GROUP BY x, z), g AS (SELECT CAST(i % 512 AS INT) AS x, i // 512 AS z FROM range(262144) t(i)) SELECT g.x, g.z, coalesce(h, 0) AS h FROM g LEFT JOIN h ON g.x = h.x AND g.z = h.z", True)
def heightmap_image(spark, d):
    h = heights.heightmap(grid(spark, d), opaque())
    plane = voxel.dense_grid(spark, 512, 1, 512).select("x", "z")
    return plane.join(h, ["x", "z"], "left").select("x", "z", F.coalesce("h", F.lit(0)).cast("long").alias("h"))


# -- neighbours, contexts, estimates ------------------------------------------------------------


@query("WITH e AS (SELECT event_type AS sym, lag(event_type, 1, '') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ctx FROM events) SELECT ctx, sym, count(*) AS n FROM e GROUP BY ctx, sym")
def context_counts(spark, d):
    return neighbours.context_counts(neighbours.previous_symbol(table(spark, d, "events"), "event_type", "user_id", "ts", "event_id"), "ctx")


@query("WITH e AS (SELECT event_type AS sym, lag(event_type, 1, '') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ctx FROM events), c AS (SELECT ctx, sym, count(*) AS n FROM e GROUP BY ctx, sym), t AS (SELECT ctx, sym, n, sum(n) OVER (PARTITION BY ctx) AS tot FROM c) SELECT ctx, CAST(sum(n) AS BIGINT) AS n, round(sum(-n * log2(CAST(n AS DOUBLE) / tot)) / sum(n), 6) AS bits_per_symbol FROM t GROUP BY ctx")
def conditional_entropy(spark, d):
    return neighbours.conditional_entropy(context_counts(spark, d), "ctx")


@query("+e AS (SELECT v.block AS sym, coalesce(a.block, '') AS xn, coalesce(b.block, '') AS yn, coalesce(c.block, '') AS zn FROM voxel v LEFT JOIN voxel a ON a.x = v.x - 1 AND a.y = v.y AND a.z = v.z LEFT JOIN voxel b ON b.x = v.x AND b.y = v.y - 1 AND b.z = v.z LEFT JOIN voxel c ON c.x = v.x AND c.y = v.y AND c.z = v.z - 1), k AS (SELECT xn, yn, zn, sym, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY xn, yn, zn) AS tot FROM k) SELECT round(sum(-n * log2(CAST(n AS DOUBLE) / tot)) / sum(n), 6) AS bits_per_block, CAST(sum(n) AS BIGINT) AS n_blocks FROM t", True)
def ctx3_entropy(spark, d):
    return neighbours.total_entropy(neighbours.context_counts(neighbours.grid_contexts(grid(spark, d)), "xn", "yn", "zn"), "xn", "yn", "zn")


@query("SELECT block, light, count(*) AS n FROM voxel GROUP BY block, light", True)
def light_hist(spark, d):
    return neighbours.light_histogram(grid(spark, d))


@query(f"+{MX} SELECT block, light AS bin, count(*) AS n FROM mx WHERE light > 0 AND light >= mn GROUP BY block, light", True)
def emission_hist(spark, d):
    return neighbours.emission_histogram(neighbours.brightest_neighbour(grid(spark, d)))


@query(f"+b AS (SELECT x, y, z, block, CASE WHEN block = 'error' THEN 15 ELSE light % 8 END AS light FROM voxel), {OFF}, mx AS (SELECT v.x, v.y, v.z, v.block, v.light, max(coalesce(n.light, 0)) AS mn FROM b v CROSS JOIN off LEFT JOIN b n ON n.x = v.x + dx AND n.y = v.y + dy AND n.z = v.z + dz GROUP BY ALL), t AS (SELECT block, count(*) AS total, count(*) FILTER (WHERE light > 0) AS samples FROM mx GROUP BY block), h AS (SELECT block, light AS bin, count(*) AS n FROM mx WHERE light > 0 AND light >= mn GROUP BY block, light), k AS (SELECT h.block, bin, row_number() OVER (PARTITION BY h.block ORDER BY n DESC, bin) AS rn FROM h JOIN t ON h.block = t.block WHERE n > floor(samples / 12)) SELECT t.block, CAST(CASE WHEN samples = 0 OR CAST(samples AS DOUBLE) / total < 0.80 THEN 0 ELSE coalesce(k.bin, 0) END AS INT) AS emission FROM t LEFT JOIN k ON k.block = t.block AND k.rn = 1", True)
def emission_estimate(spark, d):
    cells = grid(spark, d).withColumn("light", F.when(F.col("block") == "error", 15).otherwise(F.col("light") % 8))
    return neighbours.emission_estimate(neighbours.brightest_neighbour(cells))


@query(f"+{MX}, h AS (SELECT block, mn - light AS bin, count(*) AS n, sum(count(*)) OVER (PARTITION BY block) AS samples FROM mx WHERE mn > 0 AND light < mn GROUP BY block, mn - light) SELECT block, max(CASE WHEN n > floor(samples / 12) THEN bin END) AS opacity FROM h GROUP BY block", True)
def opacity_estimate(spark, d):
    return neighbours.opacity_estimate(neighbours.opacity_histogram(neighbours.brightest_neighbour(grid(spark, d))))


@query("WITH e AS (SELECT user_id, CAST(floor(value) AS INT) % 16 AS b FROM events WHERE value > 0), h AS (SELECT user_id, b, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS tot FROM e GROUP BY user_id, b), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, b) AS rn FROM h WHERE n > tot / 12) SELECT user_id, b AS emission, n FROM k WHERE rn = 1")
def hist_emission(spark, d):
    return neighbours.value_mode(table(spark, d, "events").filter("value > 0"), "user_id", F.floor("value").cast("int") % 16)


# -- hidden cells -------------------------------------------------------------------------------


@query("WITH w AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT event_id, CASE WHEN p = n AND p <> event_type THEN p ELSE event_type END AS event_type FROM w")
def hidden_sequence(spark, d):
    return hidden.smooth_sequence(table(spark, d, "events"), "event_type", "user_id", "ts", "event_id").select("event_id", "event_type")


HID = f"+{OFF}, nb AS (SELECT v.x, v.y, v.z, n.block FROM voxel v CROSS JOIN off JOIN voxel n ON n.x = v.x + dx AND n.y = v.y + dy AND n.z = v.z + dz), hid AS (SELECT x, y, z FROM nb GROUP BY x, y, z HAVING count(*) = 6 AND sum(CASE WHEN block = 'view' THEN 1 ELSE 0 END) = 0), f AS (SELECT nb.x, nb.y, nb.z, block, count(*) AS n FROM nb JOIN hid USING (x, y, z) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY n DESC, block) AS rn FROM f)"


@query(HID + " SELECT x, y, z, block AS replacement, n FROM r WHERE rn = 1", True)
def hidden6(spark, d):
    return hidden.replacements(grid(spark, d), F.col("block") == "view")


@query(HID + " SELECT v.x, v.y, v.z, coalesce(r.block, v.block) AS block FROM voxel v LEFT JOIN r ON r.rn = 1 AND r.x = v.x AND r.y = v.y AND r.z = v.z", True)
def hidden_replaced(spark, d):
    return Pipe.parse('remove_hidden_blocks{samples=0,cum_freqs=false,transparent=["view"],whitelist=null}').apply(grid(spark, d)).select("x", "y", "z", "block")


@query()
def hidden_running(spark, d):
    return Pipe.parse('remove_hidden_blocks{samples=16,transparent=["view"],whitelist=null}').apply(grid(spark, d)).select("x", "y", "z", "block")


# -- light --------------------------------------------------------------------------------------

LIT = f"{OFF}, a AS (SELECT x, y, z, CASE WHEN block = 'error' AND light >= 8 THEN light ELSE 0 END AS emit, CASE block WHEN 'purchase' THEN 3 WHEN 'signup' THEN 15 ELSE 1 END AS op FROM voxel)"


@query(f"WITH RECURSIVE {VOXEL_SQL}, {LIT}, r(x, y, z, lvl) AS (SELECT x, y, z, emit FROM a WHERE emit > 0 UNION SELECT n.x, n.y, n.z, r.lvl - n.op FROM r CROSS JOIN off JOIN a n ON n.x = r.x + dx AND n.y = r.y + dy AND n.z = r.z + dz WHERE r.lvl - n.op > 0) SELECT x, y, z, max(lvl) AS lvl FROM r GROUP BY x, y, z")
def block_light(spark, d):
    cells = grid(spark, d)
    seeds = cells.filter((F.col("block") == "error") & (F.col("light") >= 8)).select("x", "y", "z", F.col("light").alias("lvl"))
    return light.propagate(seeds, cells.select("x", "y", "z", _opacity().alias("op")))


def _opacity() -> Column:
    return F.when(F.col("block") == "purchase", 3).when(F.col("block") == "signup", 15).otherwise(1)


@query(f"WITH RECURSIVE {VOXEL_SQL}, {LIT}, h AS (SELECT x, z, coalesce(max(CASE WHEN block IN ('error', 'purchase') THEN y END) + 1, 0) AS h FROM voxel GROUP BY x, z), s AS (SELECT v.x, v.y, v.z, 15 AS lvl FROM voxel v JOIN h ON v.x = h.x AND v.z = h.z WHERE v.y >= h.h), r(x, y, z, lvl) AS (SELECT x, y, z, lvl FROM s UNION SELECT n.x, n.y, n.z, r.lvl - n.op FROM r CROSS JOIN off JOIN a n ON n.x = r.x + dx AND n.y = r.y + dy AND n.z = r.z + dz WHERE r.lvl - n.op > 0) SELECT x, y, z, max(lvl) AS lvl FROM r GROUP BY x, y, z")
def sky_light(spark, d):
    cells = grid(spark, d)
    return light.sky_light(cells, heights.heightmap(cells, opaque()), cells.select("x", "y", "z", _opacity().alias("op")))


@query("SELECT CASE WHEN x = 0 THEN 'xn' WHEN x = 31 THEN 'xp' WHEN z = 0 THEN 'zn' ELSE 'zp' END AS face, count(*) AS n, CAST(sum(light) AS BIGINT) AS s FROM voxel WHERE x IN (0, 31) OR z IN (0, 31) GROUP BY 1", True)
def light_borders(spark, d):
    return light.border_faces(grid(spark, d), 31).groupBy("face").agg(F.count("*").alias("n"), F.sum("light").alias("s"))


@query("SELECT face, count(*) AS n FROM (SELECT unnest([CASE WHEN x = 0 THEN 'xn' END, CASE WHEN x = 31 THEN 'xp' END, CASE WHEN z = 0 THEN 'zn' END, CASE WHEN z = 31 THEN 'zp' END]) AS face FROM voxel) WHERE face IS NOT NULL GROUP BY face", True)
def light_border_planes(spark, d):
    return light.border_faces(grid(spark, d), 31, every_plane=True).groupBy("face").agg(F.count("*").alias("n"))


@query("+h AS (SELECT x, z, coalesce(max(CASE WHEN block IN ('error', 'purchase') THEN y END) + 1, 0) AS h FROM voxel GROUP BY x, z) SELECT v.x, v.y, v.z, 15 AS lvl FROM voxel v JOIN h ON v.x = h.x AND v.z = h.z WHERE v.y >= h.h", True)
def sky_columns(spark, d):
    cells = grid(spark, d)
    return light.sky_columns(cells, heights.heightmap(cells, opaque()))


@query("WITH RECURSIVE r(n, lvl) AS (SELECT n_nationkey, 15 FROM nation WHERE n_nationkey IN (0, 12) UNION ALL SELECT n.n_nationkey, r.lvl - 1 FROM r JOIN nation n ON abs(n.n_nationkey - r.n) = 1 WHERE r.lvl > 1) SELECT n AS n_nationkey, max(lvl) AS lvl FROM r GROUP BY n")
def relax_line(spark, d):
    line = table(spark, d, "nation").select(F.col("n_nationkey").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("z"))
    seeds = line.filter("x in (0, 12)").withColumn("lvl", F.lit(15))
    return light.propagate(seeds, line.withColumn("op", F.lit(0))).select(F.col("x").alias("n_nationkey"), "lvl")


# -- merges and lookups -------------------------------------------------------------------------


@query("SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS only_right FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 150000) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def symdiff(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return merge.symmetric_difference(orders.filter("o_orderstatus = 'F'"), orders.filter("o_totalprice > 150000"), ["k"])


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'")
def symdiff_twice(spark, d):
    right = table(spark, d, "orders").filter("o_totalprice > 150000").withColumnRenamed("o_custkey", "k")
    return merge.symmetric_difference(symdiff(spark, d), right, ["k"]).select("k")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 GROUP BY 1) b ON a.k = b.k")
def opaque_merge(spark, d):
    def best(rule):
        return table(spark, d, "orders").filter(rule).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))

    return merge.merge_preferring(best("o_orderstatus = 'O' AND o_totalprice > 100000"), best("o_orderstatus = 'F'"), ["k"], ["v"])


@query("WITH rn AS (SELECT 5 AS v, 'view' AS old, 'click' AS new UNION ALL SELECT 20, 'view', 'purchase'), j AS (SELECT e.event_id, e.event_type, r.new, row_number() OVER (PARTITION BY e.event_id ORDER BY r.v) AS k FROM (SELECT event_id, event_type, event_id % 30 AS ver FROM events) e LEFT JOIN rn r ON r.old = e.event_type AND e.ver <= r.v) SELECT event_id, coalesce(new, event_type) AS resolved FROM j WHERE k = 1")
def version_asof(spark, d):
    records = spark.createDataFrame([(5, "view", "click"), (20, "view", "purchase")], "v int, old string, new string")
    return merge.as_of(table(spark, d, "events").withColumn("ver", F.col("event_id") % 30), records, "event_type", "ver").select("event_id", "resolved")


@query("SELECT event_id, user_id, ts, max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prev FROM events")
def last_seen(spark, d):
    return merge.last_seen(table(spark, d, "events"), F.col("event_type") == "error", "ts", "user_id", "ts", "event_id").select("event_id", "user_id", "ts", "prev")


@query("WITH RECURSIVE rn AS (SELECT n_nationkey AS old, n_nationkey + 7 AS new FROM nation WHERE n_nationkey + 7 < 25), r(name, cur, depth) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION ALL SELECT r.name, rn.new, r.depth + 1 FROM r JOIN rn ON rn.old = r.cur) SELECT name, max(cur) AS latest, max(depth) AS hops FROM r GROUP BY name")
def alias_closure(spark, d):
    nation = table(spark, d, "nation")
    renames = nation.filter("n_nationkey + 7 < 25").select(F.col("n_nationkey").alias("old"), (F.col("n_nationkey") + 7).alias("new"))
    return merge.alias_closure(spark, nation.select("n_nationkey"), renames)


@query("SELECT c_custkey, coalesce(n_name, 'nation:' || c_nationkey) AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 12) ON c_nationkey = n_nationkey")
def lookup_with_default(spark, d):
    nation = table(spark, d, "nation").filter("n_nationkey < 12").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return merge.with_default(table(spark, d, "customer"), nation, ["c_nationkey"], {"n_name": F.concat(F.lit("nation:"), F.col("c_nationkey"))}).select("c_custkey", "n_name")


@query("WITH s AS (SELECT p_partkey, 'b' || p_size % 3 AS name, p_size % 2 = 0 AS lit, p_size % 7 AS age FROM part) SELECT p_partkey, CAST(CASE WHEN age > 4 THEN -1 ELSE (CASE WHEN lit THEN 0 ELSE 1 END) + 2 * age END AS BIGINT) AS state_id, age > 4 AS made FROM s")
def state_lookup(spark, d):
    names_ = spark.range(3).select(F.concat(F.lit("b"), "id").alias("name"))
    states = names_.select("name", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("state_id"))
    states = states.select("name", F.create_map(F.lit("age"), F.floor(F.col("state_id") / 2).cast("string"), F.lit("lit"), F.when(F.col("state_id") % 2 == 0, "true").otherwise("false")).alias("props"), "state_id", (F.col("state_id") == 0).alias("is_default"))
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("b"), F.col("p_size") % 3).alias("name"), F.map_filter(F.create_map(F.lit("lit"), F.when(F.col("p_size") % 2 == 0, "true").otherwise("false"), F.lit("age"), (F.col("p_size") % 7).cast("string")), lambda k, v: ~((k == "age") & (v == "0"))).alias("props"))
    found, made = merge.state_lookup(rows, states), F.col("state_id") < 0
    return found.select("p_partkey", F.greatest(F.col("state_id"), F.lit(-1)).alias("state_id"), made.alias("made"))


@query("WITH a AS (SELECT event_id, event_type, value FROM events), b AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'x' ELSE event_type END AS event_type, value FROM events WHERE event_id % 70 <> 0) SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN a.event_id IS NULL THEN 'right only' WHEN b.event_id IS NULL THEN 'left only' ELSE 'differs' END AS what FROM a FULL JOIN b ON a.event_id = b.event_id WHERE a.event_id IS NULL OR b.event_id IS NULL OR a.event_type IS DISTINCT FROM b.event_type OR a.value IS DISTINCT FROM b.value")
def differences(spark, d):
    a = table(spark, d, "events").select("event_id", "event_type", "value")
    b = a.filter("event_id % 70 <> 0").withColumn("event_type", F.when(F.col("event_id") % 50 == 0, "x").otherwise(F.col("event_type")))
    return merge.differences(a, b, ["event_id"], ["event_type", "value"])


@query("SELECT doc_id, CASE WHEN n_chars <= 131072 AND lower(source) LIKE '%1%' THEN 'blob' WHEN n_chars <= 131072 THEN 'small' ELSE 'copy' END AS sink FROM documents")
def route(spark, d):
    small = F.col("n_chars") <= filters.SMALL_FILE
    return table(spark, d, "documents").select("doc_id", merge.first_route([("blob", small & F.lower("source").contains("1")), ("small", small)], "copy").alias("sink"))


# -- filters ------------------------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE (p_size & 7) = 5")
def opaque_flags(spark, d):
    return table(spark, d, "part").filter(filters.is_opaque(F.col("p_size"))).select("p_partkey")


@query("SELECT p_partkey, (p_size & 6) = 6 AS has FROM part")
def mask_test(spark, d):
    return table(spark, d, "part").select("p_partkey", filters.has_all(F.col("p_size"), 6).alias("has"))


@query("SELECT x, y, z FROM voxel WHERE x % 16 IN (0, 15) OR z % 16 IN (0, 15)", True)
def section_edges(spark, d):
    return grid(spark, d).filter(filters.on_edge(F.col("x") % 16, F.col("z") % 16)).select("x", "y", "z")


@query("SELECT x, y, z FROM voxel WHERE block IN ('click', 'signup') AND NOT (x % 16 IN (0, 15) OR z % 16 IN (0, 15))", True)
def predicted_upgrades(spark, d):
    return filters.predicted_indices(grid(spark, d), filters.upgradeable(F.concat(F.lit("minecraft:"), "block"), ["click", "signup"])).select("x", "y", "z")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4000 BETWEEN 0 AND 1343 THEN 'old' WHEN o_orderkey % 4000 BETWEEN 1451 AND 2692 THEN 'new' ELSE 'passthrough' END AS serializer FROM orders")
def serializer_by_version(spark, d):
    return table(spark, d, "orders").select("o_orderkey", filters.by_version(F.col("o_orderkey") % 4000, [(0, 1343, "old"), (1451, 2692, "new")]).alias("serializer"))


@query("SELECT event_id FROM events WHERE NOT ((1900 + event_id % 200) >= 1976 AND event_type IN ('click', 'view') AND (event_id % 3 = 0))")
def empty_chunks_removed(spark, d):
    events = table(spark, d, "events")
    status = F.when(F.col("event_type") == "click", "empty").when(F.col("event_type") == "view", "noise").when(F.col("event_type") == "error", "surface").otherwise("full")
    lists = [F.when(F.col("event_id") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))]
    return filters.remove_empty_chunks(events, 1900 + F.col("event_id") % 200, status, lists, [], F.lit(None).cast("map<string,int>")).select("event_id")


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'click')")
def whitelist(spark, d):
    return filters.whitelisted(table(spark, d, "events"), spark.createDataFrame([("error",), ("click",)], "event_type string"), "event_type").select("event_id")


@query("SELECT page_id, (lower(url) LIKE '%.html') AND length(html) <= 131072 AS small FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, html FROM pages)")
def small_files(spark, d):
    own = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("url"), F.length("html").alias("n"))
    return own.select("page_id", filters.is_small_file(F.col("url"), F.col("n"), [".html"]).alias("small"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IS NOT NULL AND s_acctbal IS NOT NULL")
def existing_rows(spark, d):
    return filters.checked(filters.existing(table(spark, d, "supplier"), "s_suppkey", "s_acctbal"), F.col("s_suppkey") >= 0, "keys are not negative").select("s_suppkey")


@query("SELECT o_orderkey, CASE WHEN v < 1500 THEN NOT k LIKE '%\\_WG' ESCAPE '\\' WHEN s = 'full' THEN NOT k LIKE '%\\_WG' ESCAPE '\\' ELSE true END AS need FROM (SELECT o_orderkey, o_orderkey % 3000 AS v, CASE o_orderstatus WHEN 'F' THEN 'full' ELSE 'light' END AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'OCEAN_FLOOR_WG' ELSE 'OCEAN_FLOOR' END AS k FROM orders)")
def needed_heightmaps(spark, d):
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "OCEAN_FLOOR_WG").otherwise("OCEAN_FLOOR")
    return o.select("o_orderkey", heights.needs_heightmap(F.col("o_orderkey") % 3000, F.when(F.col("o_orderstatus") == "F", "full").otherwise("light"), kind, 1500).alias("need"))


@query("SELECT a AS x, b AS y, c AS z, (b < 0) OR (b = 0 AND c < 0) OR (b = 0 AND c = 0 AND a < 0) AS valid FROM range(-2, 3) r1(a), range(-2, 3) r2(b), range(-2, 3) r3(c)")
def valid_neighbours(spark, d):
    cube = voxel.dense_grid(spark, 5, 5, 5).select((F.col("x") - 2).cast("long").alias("x"), (F.col("y") - 2).alias("y"), (F.col("z") - 2).alias("z"))
    return cube.select("x", "y", "z", filters.valid_neighbour(F.col("x"), F.col("y"), F.col("z")).alias("valid"))


@query("SELECT p_partkey, NOT (p_size % 7 = 0) AS WORLD_SURFACE, p_size % 2 = 0 AS OCEAN_FLOOR, (p_size % 2 = 0 OR p_size % 3 = 0) AND NOT p_size % 5 = 0 AS MOTION_BLOCKING_NO_LEAVES, p_size % 4 > 0 AS LIGHT_BLOCKING FROM part")
def height_predicates(spark, d):
    s = F.col("p_size")
    states = table(spark, d, "part").select("p_partkey", (s % 2 == 0).alias("motion"), (s % 3 == 0).alias("fluid"), (s % 5 == 0).alias("leaves"), (s % 7 == 0).alias("air"), (s % 4).alias("opacity"))
    return filters.height_predicates(states).select("p_partkey", "WORLD_SURFACE", "OCEAN_FLOOR", "MOTION_BLOCKING_NO_LEAVES", "LIGHT_BLOCKING")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'air' WHEN p_size % 3 = 1 THEN 'stone' ELSE 'nothing known' END AS material, p_size % 3 <> 0 AS blocks_motion, p_size % 3 = 1 AS solid_blocking, p_size % 3 = 0 AS replaceable FROM part")
def material_attributes(spark, d):
    kind = F.when(F.col("p_size") % 3 == 0, "air").when(F.col("p_size") % 3 == 1, "stone").otherwise("nothing known")
    own = materials.with_material(table(spark, d, "part").select("p_partkey", kind.alias("material")))
    return own.select("p_partkey", "material", "blocks_motion", "solid_blocking", "replaceable")


# -- functions ----------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey - 700 AS v, CASE WHEN o_custkey >= 700 THEN (o_custkey - 700) * 2 ELSE -(o_custkey - 700) * 2 - 1 END AS zz, o_custkey - 700 AS back FROM orders")
def zigzag(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") - 700).alias("v")).withColumn("zz", bits.zigzag(F.col("v")))
    return o.withColumn("back", bits.unzigzag(F.col("zz")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(1 + floor((length(bin(l_partkey)) - 1) / 7) AS INT) AS n_bytes FROM lineitem")
def varint_size(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", bits.varint_size(F.col("l_partkey")).alias("n_bytes"))


@query("SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS back FROM orders GROUP BY 1")
def varint_round_trip(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("v"))
    return lists.select("o_custkey", _text(bits.varint_decode(bits.varint_encode("v"))).alias("back"))


@query("SELECT o_custkey, string_agg(o_orderkey % 512, ',' ORDER BY o_orderkey) AS spanning, string_agg(o_orderkey % 512, ',' ORDER BY o_orderkey) AS sparse FROM orders GROUP BY 1")
def bit_storage_round_trip(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x % 512).alias("v"))
    nine, n = F.lit(9), F.size("v")
    sparse = bits.sparse_unpack(F.col("p"), 9, n)
    packed = lists.select("o_custkey", "v", bits.bit_pack(F.col("v"), nine, True).alias("s"), bits.bit_pack(F.col("v"), nine, False).alias("p"))
    return packed.select("o_custkey", _text(bits.bit_unpack(F.col("s"), nine, n, True)).alias("spanning"), _text(sparse).alias("sparse"))


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey <= 1 THEN 0 ELSE length(bin(p_partkey - 1)) END AS INT) AS ceil_log, CAST(length(bin(p_partkey)) - 1 AS INT) AS floor_log, bit_count(p_partkey) = 1 AS pow2, CAST(pow(2, CASE WHEN p_partkey <= 1 THEN 0 ELSE length(bin(p_partkey - 1)) END) AS BIGINT) AS up, CAST(ceil(p_partkey / 7.0) AS BIGINT) AS cd, CAST(floor((p_partkey - 900) / 7.0) AS BIGINT) AS fd, CAST((pow(2, 3 + p_partkey % 20) - 8) AS BIGINT) AS mask FROM part")
def integer_maths(spark, d):
    p = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", bits.ceil_log2(p).alias("ceil_log"), bits.floor_log2(p).alias("floor_log"), bits.is_pow2(p).alias("pow2"), bits.round_up_pow2(p).alias("up"), bits.ceil_div(p, F.lit(7)).alias("cd"), bits.floor_div(p - 900, F.lit(7)).alias("fd"), bits.range_mask(F.lit(3), 3 + p % 20).alias("mask"))


@query("SELECT CAST(floor(x / 2) AS BIGINT) AS xh, y, z, CAST(max(CASE WHEN x % 2 = 0 THEN light ELSE 0 END) + 16 * max(CASE WHEN x % 2 = 1 THEN light ELSE 0 END) AS INT) AS byte FROM voxel GROUP BY 1, 2, 3", True)
def nibble_pairs(spark, d):
    pairs = grid(spark, d).groupBy(F.floor(F.col("x") / 2).cast("long").alias("xh"), "y", "z").agg(*(F.max(F.when(F.col("x") % 2 == k, F.col("light")).otherwise(0)).alias(f"n{k}") for k in (0, 1)))
    return pairs.select("xh", "y", "z", bits.nibble_pack(F.col("n0"), F.col("n1")).cast("int").alias("byte"))


@query("SELECT doc_id, nullif(strpos('123456789ABCDEF', nullif(substr(hex(encode(text)), 2, 1), '')), NULL)::INT AS low, nullif(strpos('123456789ABCDEF', nullif(substr(hex(encode(text)), 3, 1), '')), NULL)::INT AS high FROM documents")
def nibble_get(spark, d):
    t = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", bits.nibble(t, F.lit(0)).alias("low"), bits.nibble(t, F.lit(3)).alias("high"))


@query("SELECT p_partkey, CAST(256 * 256 * 256 * (p_partkey % 256) + 256 * 256 * ((p_partkey // 256) % 256) + 256 * ((p_partkey // 65536) % 256) + (p_partkey // 16777216) % 256 AS BIGINT) AS swapped FROM part")
def byte_swap(spark, d):
    return table(spark, d, "part").select("p_partkey", bits.byte_swap(F.col("p_partkey"), 4).cast("long").alias("swapped"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS ns, CASE WHEN strpos(p_name, ' ') = 0 THEN p_name ELSE substr(p_name, strpos(p_name, ' ') + 1) END AS path FROM part")
def name_parse(spark, d):
    name = F.regexp_replace("p_name", "^([^ ]*) ", "$1:")
    return table(spark, d, "part").select("p_partkey", names.resource_namespace(name, "").alias("ns"), names.resource_path(name).alias("path")).withColumn("ns", F.when(F.col("ns") == "", F.col("path")).otherwise(F.col("ns")))


@query("SELECT p_partkey, 'b' || p_size % 9 || '[age=' || p_size % 4 || ',lit=' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END || ']' AS state, 'b' || p_size % 9 AS name, (p_size % 4)::VARCHAR AS age FROM part")
def state_strings(spark, d):
    s = F.col("p_size")
    built = names.state_string(F.concat(F.lit("b"), s % 9), F.create_map(F.lit("lit"), F.when(s % 2 == 0, "true").otherwise("false"), F.lit("age"), (s % 4).cast("string")))
    return table(spark, d, "part").select("p_partkey", built.alias("state")).select("p_partkey", "state", names.state_name(F.col("state")).alias("name"), names.state_properties(F.col("state"))["age"].alias("age"))


@query("SELECT p_partkey, p_size % 2 + 2 * (p_size % 5) + 10 * (p_size % 3) AS id, concat_ws(',', p_size % 2, p_size % 5, p_size % 3) AS digits FROM (SELECT p_partkey, p_size::BIGINT AS p_size FROM part)")
def mixed_radix(spark, d):
    s, sizes = F.col("p_size").cast("long"), F.array(*(F.lit(n).cast("long") for n in (2, 5, 3)))
    own = table(spark, d, "part").select("p_partkey", names.mixed_radix(F.array(s % 2, s % 5, s % 3), sizes).alias("id"))
    return own.withColumn("digits", _text(names.mixed_radix_digits(F.col("id"), sizes)))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS i FROM part")
def property_index(spark, d):
    value = F.element_at(F.array(*map(F.lit, ("true", "false", "x", "y"))), F.col("p_size") % 4 + 1)
    return table(spark, d, "part").select("p_partkey", names.property_index(F.array(F.lit("true"), F.lit("false")), value).alias("i"))


@query("SELECT doc_id, CAST((doc_id - 500) * 32 AS INT) AS rx, CAST(doc_id % 7 * 32 AS INT) AS rz FROM documents")
def region_parse(spark, d):
    path = F.concat(F.lit("world/region/r."), F.col("doc_id") - 500, F.lit("."), F.col("doc_id") % 7, F.lit(".mca"))
    rx, rz = names.region_position(path)
    return table(spark, d, "documents").select("doc_id", rx.alias("rx"), rz.alias("rz"))


@query("SELECT page_id, lower(regexp_extract(u, '(\\.[^./]*)$', 1)) AS ext, regexp_replace(url, '[\\x00-\\x1f<>:\"/\\\\|?*]', '_', 'g') AS safe FROM (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS u FROM pages)")
def file_names(spark, d):
    return table(spark, d, "pages").select("page_id", names.extension(F.regexp_replace("url", r"[?#].*$", "")).alias("ext"), names.safe_file_name(F.col("url")).alias("safe"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey >= 3600 THEN (o_orderkey // 3600) || 'h ' ELSE '' END || CASE WHEN o_orderkey >= 60 THEN (o_orderkey // 60 % 60) || 'm ' ELSE '' END || (o_orderkey % 60) || 's' AS t FROM orders")
def durations(spark, d):
    return table(spark, d, "orders").select("o_orderkey", names.duration(F.col("o_orderkey")).alias("t"))


@query("SELECT x, y, z, CAST((y % 16) * 256 + (z % 16) * 16 + x % 16 AS INT) AS cell, CAST(x % 32 + 32 * (z % 32) AS INT) AS chunk, (y * 512 + z) * 512 + x AS dump FROM voxel", True)
def cell_indices(spark, d):
    x, y, z = (F.col(k) for k in "xyz")
    return grid(spark, d).select("x", "y", "z", geometry.cell_index(x.cast("int"), y.cast("int"), z.cast("int")).alias("cell"), geometry.chunk_index(x, z).alias("chunk"), geometry.dump_index(x, y, z).alias("dump"))


@query("SELECT x, y, z, CAST((light & 15) | ((light & 3) << 12) | (CASE WHEN block = 'view' THEN 16 ELSE 0 END) AS INT) AS packed, CAST(light & 15 AS INT) AS opacity FROM voxel", True)
def light_pack(spark, d):
    word = geometry.light_word(F.col("light"), F.col("light").bitwiseAND(3), F.when(F.col("block") == "view", 1).otherwise(0))
    return grid(spark, d).select("x", "y", "z", word.alias("packed"), geometry.light_parts(word)["opacity"].alias("opacity"))


@query("SELECT p_partkey, CAST(((m & 21) << 1) | ((m & 42) >> 1) AS INT) AS opposite, CASE WHEN m & 3 <> 0 THEN 'X' WHEN m & 12 <> 0 THEN 'Z' WHEN m & 48 <> 0 THEN 'Y' END AS axis, CAST((m & 1) * 32 | (m & 2) * 8 | (m & 4) AS INT) AS moved FROM (SELECT p_partkey, p_size & 63 AS m FROM part)")
def directions(spark, d):
    m = F.col("p_size").bitwiseAND(63)
    return table(spark, d, "part").select("p_partkey", geometry.opposite(m).alias("opposite"), geometry.axis_of(m).alias("axis"), geometry.remap_mask(m, {1: 32, 2: 16, 4: 4}).alias("moved"))


@query("SELECT o_orderkey, (o_orderkey << 8) | (o_custkey & 255) AS location, o_orderkey AS sector, o_custkey & 255 AS n, CAST(ceil(o_custkey / 4096.0) AS BIGINT) AS need FROM orders")
def sectors(spark, d):
    o = table(spark, d, "orders").withColumn("location", geometry.sector_pack(F.col("o_orderkey"), F.col("o_custkey")))
    return o.select("o_orderkey", "location", geometry.sector_of(F.col("location")).alias("sector"), geometry.sector_count(F.col("location")).alias("n"), geometry.sectors_needed(F.col("o_custkey")).alias("need"))


@query("SELECT x, y, z, x + 1 AS ax, 2 * (z - 1) AS az FROM voxel", True)
def vectors(spark, d):
    one = geometry.vector(F.lit(1), F.lit(0), F.lit(-1))
    v = geometry.vector_add(geometry.vector(F.col("x"), F.col("y"), F.col("z")), one)
    return grid(spark, d).select("x", "y", "z", v["x"].alias("ax"), geometry.vector_scale(v, F.lit(2))["z"].alias("az"))


@query("SELECT p_partkey, 4278190080 + 65536 * CAST(floor((p_partkey % 256) * s / 255) AS BIGINT) + 256 * CAST(floor((p_partkey * 7 % 256) * s / 255) AS BIGINT) + CAST(floor((p_partkey * 3 % 256) * s / 255) AS BIGINT) AS argb FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 180 WHEN 1 THEN 220 WHEN 2 THEN 255 ELSE 135 END AS s FROM part)")
def map_colours(spark, d):
    p = F.col("p_partkey")
    rgb = (p % 256) * 65536 + (p * 7 % 256) * 256 + p * 3 % 256
    return table(spark, d, "part").select("p_partkey", geometry.shaded(rgb.cast("long"), F.col("p_size") % 4).alias("argb"))


@query("SELECT p_partkey, coalesce(TRY_CAST(v AS INT), -1) AS id, CASE WHEN TRY_CAST(v AS INT) IS NULL THEN v END AS name FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE 'stone' END AS v FROM part)")
def block_references(spark, d):
    v = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("stone")
    return table(spark, d, "part").select("p_partkey", names.block_reference(v).alias("r")).select("p_partkey", F.coalesce("r.id", F.lit(-1)).alias("id"), "r.name")


@query("SELECT p_partkey, CAST(b * 16 + m + 4096 * a AS INT) AS state FROM (SELECT p_partkey, p_partkey % 256 AS b, p_size % 16 AS m, p_size % 3 AS a FROM part)")
def legacy_state(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", names.legacy_state(p % 256, s % 16, s % 3).alias("state"))


@query(f"SELECT event_id, CAST(({codec.HASH_A}::HUGEINT * event_id + {codec.HASH_B}::HUGEINT * (event_id % 7) + {codec.HASH_C}::HUGEINT) % 18446744073709551616::HUGEINT // 4503599627370496 AS INT) AS slot FROM events")
def context_slots(spark, d):
    return table(spark, d, "events").select("event_id", codec.context_slot_column(F.col("event_id"), F.col("event_id") % 7, 12).alias("slot"))


@query("SELECT p_partkey, CAST(16 + CASE WHEN h >= k THEN 15 ELSE 0 END + CASE WHEN h = 16 OR k = 0 THEN 32 ELSE 0 END AS INT) AS mask FROM (SELECT p_partkey, p_size % 17 AS h, p_partkey % 16 AS k FROM part)")
def occlusion(spark, d):
    """Slabs of height h below slabs from height k up."""
    zero, full = F.lit(0), F.lit(16)
    h, k = (F.col("p_size") % 17).cast("int"), (F.col("p_partkey") % 16).cast("int")
    a, b = F.array(F.array(zero, zero, zero, full, h, full)), F.array(F.array(zero, k, zero, full, full, full))
    return table(spark, d, "part").select("p_partkey", geometry.occlusion_mask(a, b).alias("mask"))


# -- documents, bundles, verification -------------------------------------------------------------


@query("SELECT event_type, min(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)) AS mn, max(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)) AS mx, max(length(props)) AS max_len, count(DISTINCT length(props)) AS n_len, CASE WHEN min(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)) = max(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)) THEN 'const' WHEN max(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)) <= 255 THEN 'u8' ELSE 'u16' END AS width FROM events GROUP BY 1")
def field_stats(spark, d):
    number = schema.extract(F.parse_json("props"), "$.k", "int")
    return schema.field_stats(table(spark, d, "events"), "event_type", number, "props").withColumn("width", schema.int_width(F.col("mn"), F.col("mx")))


PROPS = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN replace(props, '}', ', \"s\": \"x\"}') WHEN 1 THEN props ELSE replace(props, '{', '{\"b\": [1, 2], ') END AS p FROM events"
KINDS = "string_agg(key || ': ' || CASE json_type(p, '$.' || key) WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'BIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'ARRAY' THEN 'ARRAY<BIGINT>' END, ', ' ORDER BY key)"


def _documents(spark, d) -> DataFrame:
    k = F.col("event_id") % 3
    own = F.when(k == 0, F.regexp_replace("props", "}", ', "s": "x"}')).when(k == 1, F.col("props")).otherwise(F.regexp_replace("props", r"\{", '{"b": [1, 2], '))
    return table(spark, d, "events").select("event_id", own.alias("p"))


@query(f"WITH d AS ({PROPS}), k AS (SELECT p, unnest(json_keys(p)) AS key FROM d), u AS (SELECT key, any_value(p) AS p FROM k GROUP BY key) SELECT 'OBJECT<' || {KINDS} || '>' AS schema FROM u")
def inferred_schema(spark, d):
    return schema.inferred_schema(_documents(spark, d), "p")


@query(f"WITH d AS ({PROPS}), k AS (SELECT event_id, p, unnest(json_keys(p)) AS key FROM d), u AS (SELECT event_id, 'OBJECT<' || {KINDS} || '>' AS shape FROM k GROUP BY event_id) SELECT shape, count(*) AS n FROM u GROUP BY shape")
def document_shapes(spark, d):
    return schema.document_shapes(_documents(spark, d), "p")


@query("WITH e AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM documents WHERE n_chars <= 131072) SELECT CAST(floor((run - 1) / 65536) AS BIGINT) AS bundle, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM e GROUP BY 1")
def blob(spark, d):
    small = table(spark, d, "documents").filter(F.col("n_chars") <= filters.SMALL_FILE).select("doc_id", "n_chars")
    return bundle.running_bundles(small, "n_chars", "doc_id", 65536).groupBy("bundle").agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"))


@query("WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents), r(source, k, doc_id, bundle, used) AS (SELECT source, k, doc_id, 0::BIGINT, n_chars FROM o WHERE k = 1 UNION ALL SELECT o.source, o.k, o.doc_id, r.bundle + (r.used > 16384)::BIGINT, CASE WHEN r.used > 16384 THEN o.n_chars ELSE r.used + o.n_chars END FROM r JOIN o ON o.source = r.source AND o.k = r.k + 1) SELECT doc_id, source, bundle FROM r")
def next_fit(spark, d):
    return bundle.next_fit(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "n_chars", "doc_id", "source", 16384).select("doc_id", "source", "bundle")


@query("SELECT 'd' || doc_id AS path, sha256(text) AS sha FROM documents")
def bundle_round_trip(spark, d):
    files = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content"), F.pmod("doc_id", F.lit(16)).alias("bundle"))
    return bundle.unpack_bundles(bundle.pack_bundles(files)).select("path", F.sha2("content", 256).alias("sha"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def gzip_round_trip(spark, d):
    docs = table(spark, d, "documents").select("doc_id", bundle.gzip_codec(F.col("text").cast("binary")).alias("z"))
    return docs.select("doc_id", F.sha2(bundle.gzip_codec(F.col("z"), unpack=True), 256).alias("sha"))


@query("SELECT user_id, count(*) AS rows, count(*) FILTER (WHERE event_id % 500 = 7) = 0 AS same FROM events GROUP BY user_id")
def content_digest(spark, d):
    """Digests of each user's events against those of a copy in which some rows differ."""
    events = table(spark, d, "events").select("user_id", "event_id", "value")
    other = events.withColumn("value", F.col("value") + F.when(F.col("event_id") % 500 == 7, 1).otherwise(0)).repartition(5, "event_id")
    a, b = (verify.content_digest(e, "event_id", "value", by=["user_id"]) for e in (events, other))
    return a.join(b.select("user_id", F.col("digest").alias("other")), "user_id").select("user_id", "rows", (F.col("digest") == F.col("other")).alias("same"))


@query("+p AS (SELECT CAST(floor(x/16) AS INT) AS cx, CAST(floor(z/16) AS INT) AS cz, CAST(floor(y/16) AS BIGINT) AS sy, sha256(CAST(floor(x/16) AS INT) || ',' || CAST(floor(z/16) AS INT) || ',' || CAST(floor(y/16) AS BIGINT) || string_agg(block, ',' ORDER BY (y % 16) * 256 + (z % 16) * 16 + x % 16)) AS sha FROM voxel GROUP BY 1, 2, 3) SELECT cx, cz, sha256(string_agg(sha, '' ORDER BY sy)) AS sha FROM p GROUP BY 1, 2", True)
def region_digest(spark, d):
    cells = grid(spark, d)
    ids = cells.select(F.col("block").alias("block"), F.col("block").alias("sym_id")).distinct()
    parts = voxel.section_arrays(cells, ids).select("cx", "cz", "sy", F.array_join("blocks", ",").cast("binary").alias("payload"))
    return verify.region_digest(parts, ["cx", "cz"], ["sy"], "payload")


@query("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events")
def tag_round_trip(spark, d):
    return table(spark, d, "events").select("event_id", F.variant_get(nbt.to_variant(nbt.from_json("props")), "$.k", "int").alias("k"))


@query("SELECT 'd' || doc_id AS path, sha256(text) AS sha FROM documents")
def zip_round_trip(spark, d):
    files = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content"), "source")
    return archive.unzip(archive.zip_bytes(files, "source")).select("path", F.sha2("content", 256).alias("sha"))


@query("SELECT x, y, z, block FROM voxel", True)
def region_round_trip(spark, d):
    """Cells to chunk documents to region files, and back."""
    import pandas as pd

    def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        cx, cz = int(pdf["cx"].iloc[0]), int(pdf["cz"].iloc[0])
        out: dict[int, list[str]] = {}
        for x, y, z, b in zip(pdf["x"], pdf["y"], pdf["z"], pdf["block"], strict=True):
            out.setdefault(y >> 4, ["air"] * 4096)[(y & 15) << 8 | (z & 15) << 4 | x & 15] = b
        return pd.DataFrame({"cx": [cx], "cz": [cz], "stamp": [0], "data": [region.chunk_document(cx, cz, 2567 if cx else 1631, out)]})

    own = grid(spark, d).select(F.floor(F.col("x") / 16).cast("int").alias("cx"), F.floor(F.col("z") / 16).cast("int").alias("cz"), "x", "y", "z", "block")
    chunks = own.groupBy("cx", "cz").applyInPandas(chunk, "cx int, cz int, stamp long, data binary")
    return region.cells_of(region.section_rows(region.chunks_of(region.region_files(chunks)))).filter("block <> 'air'")


@query("SELECT event_type, bool_and(value < 48) AS all_known, true AS any_rows FROM events GROUP BY 1")
def all_known(spark, d):
    return verify.all_known(table(spark, d, "events"), F.col("value") < 48, "event_type")


@query("SELECT x, y, z, sym_id FROM (SELECT *, CAST(sym AS INT) AS sym_id FROM voxel JOIN (SELECT block, row_number() OVER (ORDER BY count(*) DESC, block) - 1 AS sym FROM voxel GROUP BY block) USING (block))", True)
def codec_round_trip(spark, d):
    cells = grid(spark, d)
    own = palette.remap(cells, palette.palette_by_frequency(cells)).withColumn("region", F.floor(F.col("x") / 16).cast("int"))
    decoded = codec.decode_regions(codec.encode_regions(own, "region"), "region")
    return decoded.join(own.select(F.col("x").cast("long").alias("x"), "y", "z"), ["x", "y", "z"]).select(F.col("x").cast("int").alias("x"), "y", "z", "sym_id")


@query()
def codec_sizes(spark, d):
    cells = grid(spark, d)
    own = palette.remap(cells, palette.palette_by_frequency(cells)).withColumn("region", F.floor(F.col("x") / 16).cast("int"))
    return codec.encode_regions(own, "region").select("region", "palette", F.octet_length("payload").alias("bytes"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def pruned_scan(spark, d):
    """A scan whose filters and columns reach the files."""
    rows = table(spark, d, "lineitem").filter((F.col("l_shipdate") >= "1995-01-01") & (F.col("l_shipdate") < "1996-01-01") & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey")


from gridloom import world_queries  # noqa: E402, F401 - registers further queries
