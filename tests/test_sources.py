import gzip
import json
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.operators import bundle
from gridloom.plans import container
from gridloom.sources import archive, nbt, packed, region, registry

DOCUMENT = {"stringTest": "Tést 🙂", "intTest": -5, "doubleTest": 1.5, "big": 2**40, "listTest": [{"id": i, "name": f"n{i}", "seed": 2**33 + i} for i in range(4)], "ints": np.arange(5, dtype=np.int32), "longs": np.arange(3, dtype=np.int64), "raw": b"\0\xff", "none": []}
ENTRIES = {"a.txt": "plain".encode(), "sub/ü.txt": "🙂\x01".encode(), "sub/zero.bin": bytes(1 << 20), "empty": b"", "z.gz": gzip.compress(b"inner" * 100, mtime=0)}


def test_tags_round_trip():
    raw = nbt.write(nbt.of(DOCUMENT), "root")
    name, tag = nbt.read(raw)
    assert name == "root" and nbt.write(tag, name) == raw
    assert nbt.plain(tag)["listTest"][3] == {"id": 3, "name": "n3", "seed": 2**33 + 3}
    assert nbt.detect(gzip.compress(raw))[1][0] == nbt.COMPOUND
    with pytest.raises(nbt.BadTag):
        nbt.read(raw[:-3])
    with pytest.raises(nbt.BadTag):
        nbt.of([1, "x"])


def test_tags_print():
    text = nbt.pretty((nbt.COMPOUND, {"b": (nbt.BYTE, 3), "f": (nbt.FLOAT, 2.0), "l": (nbt.INTS, np.arange(40, dtype=np.int32))}))
    assert '"b": 3b' in text and '"f": 2.0f' in text and text.count("\n") > 4


def test_tags_as_variant(spark):
    df = spark.createDataFrame([(nbt.write(nbt.of(DOCUMENT)),), (b"junk",), (None,)], "d binary").select(nbt.to_variant(F.col("d")).alias("v"))
    assert [r[0] for r in df.select(F.try_variant_get("v", "$.listTest[2].name", "string")).collect()] == ["n2", None, None]


def _cells(seed, n=5):
    seed = abs(seed)
    rng = np.random.default_rng(seed)
    return [f"block{i}[k={i}]" if i % 2 else f"block{i}" for i in rng.integers(0, n, 4096)]


@pytest.mark.parametrize("version", [1631, 2567])
def test_regions_round_trip(spark, tmp_path, version):
    chunks = [(cx, cz, 7, region.chunk_document(cx, cz, version, {0: _cells(cx), -1: _cells(cz, 30)})) for cx, cz in ((0, 0), (1, 0), (31, 31), (-1, 5))]
    df = spark.createDataFrame(chunks, "cx int, cz int, stamp long, data binary")
    files = region.region_files(df)
    assert region.write_files(files, str(tmp_path)) == 2
    back = region.scan_regions(spark, str(tmp_path))
    assert sorted((r.cx, r.cz, r.stamp, bytes(r.data)) for r in back.collect()) == sorted(chunks)
    cells = region.cells_of(region.section_rows(back))
    assert cells.count() == 4 * 2 * 4096
    want = _cells(31)
    got = {(r.x, r.y, r.z): r.block for r in cells.filter("x >= 496 and z >= 496 and y between 0 and 15").collect()}
    assert all(got[496 + (i & 15), i >> 8, 496 + (i >> 4 & 15)] == want[i] for i in range(4096))


def test_region_codecs_and_errors():
    for codec in (region.GZIP, region.ZLIB, region.RAW):
        raw = region.write_region({5: b"x" * 9000, 1000: b""}, codec=codec)
        assert len(raw) % region.SECTOR == 0
        assert {i: d for i, _, _, d in region.read_chunks(raw)} == {5: b"x" * 9000, 1000: b""}
    with pytest.raises(ValueError):
        region.region_of("x.mca")
    assert list(region.read_chunks(b"")) == []


def test_chunks_above_255_sectors():
    """The table has one byte for the sectors of a chunk; longer ones come back whole, and so do those behind them."""
    chunks = {0: np.random.default_rng(7).bytes(255 * region.SECTOR), 7: b"y" * 5000, 1023: bytes(3 << 20)}
    for codec in (region.ZLIB, region.RAW):
        assert {i: d for i, _, _, d in region.read_chunks(region.write_region(chunks, codec=codec))} == chunks


def test_legacy_sections():
    section = {"Blocks": (nbt.BYTES, bytes([1] * 4096)), "Data": (nbt.BYTES, bytes([0x21] * 2048)), "Add": (nbt.BYTES, bytes([0x01] * 2048))}
    ids = region.legacy_ids(section)
    assert ids[:2].tolist() == [1 << 4 | 1 | 1 << 12, 1 << 4 | 2]


def test_path_escape(spark, tmp_path):
    df = spark.createDataFrame([("../x", b"1")], "path string, content binary")
    with pytest.raises(Exception, match="outside"):
        region.write_files(df, str(tmp_path / "in"))


def test_archives(spark, tmp_path):
    for name, data in ENTRIES.items():
        p = tmp_path / "dir" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, data in ENTRIES.items():
            z.writestr(name, data)
    for path in ("dir", "a.zip"):
        rows = archive.scan(spark, str(tmp_path / path)).collect()
        assert {r.path: bytes(r.content) for r in rows} == ENTRIES and all(r.length == len(r.content) for r in rows)
    packed = archive.zip_bytes(archive.scan(spark, str(tmp_path / "dir")).withColumn("g", F.lit("one")), "g").first()
    (tmp_path / "b.zip").write_bytes(bytes(packed.content))
    assert {r.path: bytes(r.content) for r in archive.scan(spark, str(tmp_path / "b.zip")).collect()} == ENTRIES


@given(st.recursive(
    st.one_of(
        st.integers(-(2**63), 2**63 - 1).map(lambda n: (nbt.LONG, n)), st.integers(0, 255).map(lambda n: (nbt.BYTE, n)), st.integers(-(2**15), 2**15 - 1).map(lambda n: (nbt.SHORT, n)),
        st.floats(allow_nan=False).map(lambda x: (nbt.DOUBLE, x)), st.text(max_size=5).map(lambda s: (nbt.STRING, s)), st.binary(max_size=5).map(lambda b: (nbt.BYTES, b)),
        st.lists(st.integers(-9, 9), max_size=4).map(lambda v: (nbt.LIST, (nbt.INT if v else nbt.END, v))), st.lists(st.integers(-9, 9), max_size=4).map(lambda v: (nbt.INTS, np.array(v, np.int32))),
    ),
    lambda inner: st.dictionaries(st.sampled_from("abc"), inner, max_size=3).map(lambda d: (nbt.COMPOUND, d)), max_leaves=8,
))
@settings(max_examples=150, deadline=None)
def test_packed_tags(tag):
    documents = [("", tag), ("x", (nbt.COMPOUND, {"a": tag, "b": (nbt.STRING, "again")})), ("", (nbt.COMPOUND, {"a": tag, "b": (nbt.STRING, "again")}))]
    assert [nbt.write(t, n) for n, t in packed.unpack(packed.pack(documents))] == [nbt.write(t, n) for n, t in documents]


def test_packed_tags_are_smaller():
    documents = [("", nbt.of({"id": "minecraft:chest", "x": 1000 + i, "y": 64, "z": -5 * i, "Items": [{"Slot": k, "id": "stone", "Count": 1} for k in range(3)]})) for i in range(300)]
    data = packed.pack(documents)
    assert len(packed.unpack(data)) == 300 and len(data) < 0.8 * len(zlib.compress(b"".join(nbt.write(t, n) for n, t in documents), 6))
    with pytest.raises(nbt.BadTag):
        packed.unpack(zlib.compress(b"\x09"))


def test_bundles():
    assert bundle.read_bundle(bundle.write_bundle([])) == []
    back = dict(bundle.read_bundle(bundle.write_bundle(list(ENTRIES.items()))))
    assert {k: v for k, v in back.items() if k != "z.gz"} == {k: v for k, v in ENTRIES.items() if k != "z.gz"}
    assert gzip.decompress(back["z.gz"]) == b"inner" * 100


def test_registry(spark, tmp_path):
    p = tmp_path / "blocks.json"
    p.write_text('/* known */ ' + json.dumps([{"names": ["a", "b"], "numStates": 2, "defaultStateId": 1, "material": "stone", "properties": [], "states": {"flags": [5], "light": [0x1F, 0x20]}}]))
    rows = {(r.name, r.state): r for r in registry.block_states(registry.read_json(spark, str(p), registry.BLOCKS)).collect()}
    assert len(rows) == 4 and rows["b", 1].emission == 2 and rows["b", 1].opacity == 0 and rows["a", 0].opacity == 15 and rows["a", 1].is_default and rows["a", 1].flags == 5


def test_metadata(spark, tmp_path):
    registry.write_metadata(spark, str(tmp_path / "m"), 1, 1, ["x"])
    assert registry.read_metadata(spark, str(tmp_path / "m"))["transforms"] == ["x"]
    registry.write_metadata(spark, str(tmp_path / "n"), 1, 2, [])
    with pytest.raises(ValueError):
        registry.read_metadata(spark, str(tmp_path / "n"))


def test_container(spark, tmp_path):
    rows = [(x, y, z, "stone" if (x + y * z) % 3 else "air") for x in range(0, 600, 60) for y in range(4) for z in range(5)]
    cells = spark.createDataFrame(rows, "x int, y long, z long, block string")
    opaque = F.col("block") == "stone"
    from gridloom.operators.heights import heightmap

    h = heightmap(cells, opaque).withColumn("h", F.when(F.col("x") == 0, F.col("h") + 1).otherwise(F.col("h")))
    container.write(cells, str(tmp_path / "c"), opaque, h)
    assert sorted(map(tuple, container.read_cells(spark, str(tmp_path / "c")).collect())) == sorted(rows)
    assert {r.x for r in container.read_cells(spark, str(tmp_path / "c"), 1, 0).collect()} == {540}
    assert sorted(map(tuple, container.read_heights(spark, str(tmp_path / "c"), opaque).collect())) == sorted(map(tuple, h.collect()))
