import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import bundle, filters, hidden, light, merge, palette, verify
from gridloom.plans.pipeline import PRESETS, Pipe, PredictIndices, keep_or_strip


def cells(spark, side=6, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(x, y, z, str(rng.choice(["air", "stone", "dirt"], p=[0.05, 0.6, 0.35])), int(rng.integers(0, 16))) for y in range(side) for z in range(side) for x in range(side)]
    return rows, spark.createDataFrame(rows, "x int, y long, z long, block string, light int")


def test_light_against_search(spark):
    rng = np.random.default_rng(5)
    at = [(x, y, z) for x in range(7) for y in range(4) for z in range(7)]
    op = {p: int(rng.choice([0, 1, 3, 15])) for p in at}
    seeds = {(0, 0, 0): 15, (6, 3, 6): 9}
    level = dict(seeds)
    queue = list(seeds)
    while queue:
        x, y, z = p = queue.pop(0)
        for dx, dy, dz in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)):
            q = (x + dx, y + dy, z + dz)
            if q in op and level[p] - max(1, op[q]) > level.get(q, 0):
                level[q] = level[p] - max(1, op[q])
                queue.append(q)
    got = light.propagate(spark.createDataFrame([(*p, v) for p, v in seeds.items()], "x int, y long, z long, lvl int"), spark.createDataFrame([(*p, v) for p, v in op.items()], "x int, y long, z long, op int"))
    assert {(r.x, r.y, r.z): r.lvl for r in got.collect()} == level


def hidden_by_hand(rows, offsets, may, running):
    """The cells in order, each seeing what stands around it by then (running) or stood there before."""
    old = {(x, y, z): b for x, y, z, b, _ in rows}
    now, out = dict(old), {}
    counts: dict = {}
    top = None
    for y, z, x in sorted((y, z, x) for x, y, z in old):
        seen = now if running else old
        if seen[x, y, z] not in may:
            continue
        if not running:
            counts, top = {}, None
        six = [seen.get((x + dx, y + dy, z + dz)) for dx, dy, dz in hidden.SIX]
        hides = None not in six and "air" not in six
        touching = six if hides else six[: min(i for i, b in enumerate(six) if b in (None, "air"))]
        for b in touching + ([c for dx, dy, dz in offsets if (c := seen.get((x + dx, y + dy, z + dz)))] if hides else []):
            counts[b] = counts.get(b, 0) + 1
            if top is None or counts[b] > counts[top]:
                top = b
        if hides:
            out[x, y, z] = top if running else min(counts, key=lambda b: (-counts[b], b))
            now[x, y, z] = out[x, y, z]
    return old | out


def test_hidden_cells(spark):
    rows, df = cells(spark)
    offsets = hidden.neighbour_sample(2, 8)
    plain = {(r.x, r.y, r.z): r.block for r in hidden.replace_hidden(df, F.col("block") == "air", offsets=[*hidden.SIX, *offsets]).collect()}
    assert plain == hidden_by_hand(rows, offsets, {"stone", "dirt", "air"}, False) and plain != {r[:3]: r[3] for r in rows}
    kept = hidden.replace_hidden(df, F.col("block") == "air", whitelist=[])
    assert {(r.x, r.y, r.z): r.block for r in kept.collect()} == {r[:3]: r[3] for r in rows}
    # through the pipe, with the whitelist that holds by default
    for text, running in (("remove_hidden_blocks", True), ("remove_hidden_blocks{cum_freqs=false}", False)):
        got = Pipe.parse(text).apply(df)
        assert got.columns == df.columns
        found = {(r.x, r.y, r.z): r.block for r in got.collect()}
        assert found == hidden_by_hand(rows, offsets, {"stone", "dirt"}, running)
    named = df.withColumn("block", F.concat(F.lit("minecraft:"), "block"))
    assert {(r.x, r.y, r.z): r.block for r in Pipe.parse("remove_hidden_blocks").apply(named).collect()} == {k: f"minecraft:{v}" for k, v in hidden_by_hand(rows, offsets, {"stone", "dirt"}, True).items()}


def test_neighbour_sample():
    got = hidden.neighbour_sample(2, 16)
    assert len(set(got)) == 16 and not set(got) & {*hidden.SIX, (0, 0, 0)} and got == hidden.neighbour_sample(2, 16)


def test_pipe_reverses(spark):
    rows, df = cells(spark)
    pipe = Pipe.parse("rename{old=dirt,new=mud},sort_palette")
    changed = pipe.apply(df)
    assert {r.block for r in changed.select("block").distinct().collect()} == {"air", "stone", "mud"}
    assert sorted(map(tuple, pipe.reverse(changed).select("x", "y", "z", "block", "light").collect())) == sorted(rows)
    a, b = (spark.createDataFrame(x, "section int, index int") for x in ([(1, 2), (1, 3)], [(1, 3), (2, 4)]))
    step = PredictIndices(b)
    assert sorted(map(tuple, step.reverse(step.apply(a)).collect())) == [(1, 2), (1, 3)]
    assert PRESETS["fast"].with_values(context_bits=3, codec=None).context_bits == 3
    assert [keep_or_strip("auto", k) for k in (True, False)] == ["strip", "keep"]


def test_numbers_and_running_sums_over_ranges(spark):
    """Many more rows than a sample of a range exchange holds: the numbers have no gap, the sums none either."""
    df = spark.range(30_000).select(F.xxhash64("id").alias("k"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("s"), F.col("id") % 5000)).alias("s"), (F.col("id") % 7).alias("n"))
    orders = ((["k"], lambda r: r.k), (["s", "k"], lambda r: (r.s is not None, r.s or "", r.k)), ([-F.col("n"), "k"], lambda r: (-r.n, r.k)))
    for order, key in orders:
        got = palette.numbered(df, *order, name="i").collect()
        assert sorted(r.i for r in got) == list(range(30_000))
        keys = [key(r) for r in sorted(got, key=lambda r: r.i)]
        assert keys == sorted(keys)
    run, want = 0, {}
    for r in sorted(df.collect(), key=lambda r: r.k):
        run += r.n
        want[r.k] = (run - 1) // 1000
    assert {r.k: r.bundle for r in bundle.running_bundles(df, "n", "k", 1000).collect()} == want


def test_digest_ignores_order_and_palette_numbers(spark):
    _, df = cells(spark)
    assert verify.content_digest(df).first() == verify.content_digest(df.orderBy(F.rand(1))).first()
    assert verify.content_digest(df).first() != verify.content_digest(df.union(df.limit(1))).first()


def test_maps_and_documents(spark):
    row = spark.range(1).select(merge.merge_maps(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3))).alias("m"), verify.same_document(F.parse_json(F.lit('{"a":1,"b":2}')), F.parse_json(F.lit('{"b":2,"a":1}'))).alias("s")).first()
    assert row.m == {"a": 1, "b": 3} and row.s


def test_assertions(spark):
    df = spark.range(3)
    assert filters.checked(df, F.col("id") >= 0, "no").count() == 3
    with pytest.raises(Exception, match="too many"):
        filters.checked(df, F.col("id") < 2, "too many").collect()


def test_empty_inputs(spark):
    _, df = cells(spark)
    none = df.filter("false")
    assert hidden.replace_hidden(none, F.col("block") == "air").count() == 0
    assert light.propagate(none.select("x", "y", "z", F.lit(15).alias("lvl")), df.select("x", "y", "z", F.lit(1).alias("op"))).count() == 0
    assert bundle.running_bundles(none.withColumn("n", F.lit(1)), "n", "x", 5).count() == 0


def test_stream_of_bundles(spark, tmp_path):
    from gridloom.streaming import bundles

    (tmp_path / "in").mkdir()
    for i in range(6):
        (tmp_path / "in" / f"{i}.txt").write_bytes(bytes([i]) * 100)
    q = bundles.bundle_stream(bundles.stream_files(spark, str(tmp_path / "in"), files_per_batch=4), str(tmp_path / "out"), str(tmp_path / "cp"), cap=150).trigger(availableNow=True).start()
    q.awaitTermination()
    back = bundle.unpack_bundles(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert sorted(bytes(r.content) for r in back) == [bytes([i]) * 100 for i in range(6)]
