"""Packing a world of files into tables and back: region files by their cells, small files in bundles, others as they are.

The routes are columns of one scan; every route is one write, and nothing is gathered on the driver.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.names import extension
from gridloom.operators import bundle, codec, derived, filters, palette
from gridloom.plans.pipeline import PRESETS, Pipe, Preset, RemoveEmptyChunks, SimplifyUpgradeData, keep_or_strip
from gridloom.sources import archive, region, registry

#: Extensions of files that are bundled, the folder of the container's own entries, the container's version.
BUNDLED = [".json", ".dat", ".dat_old", ".nbt", ".mcfunction", ".mcmeta", ".yml", ".yaml", ".toml"]
OWN_FOLDER, VERSION = "gridloom", 1
_SECTIONS = "array<struct<sy:int,palette:array<string>,ids:binary>>"
_CHUNKS = f"path string, place int, stamp long, version int, rest binary, sections {_SECTIONS}, failed string"
_CELLS = "path string, place int, sy int, i int, x int, y long, z long, block string"


def routed(entries: DataFrame) -> DataFrame:
    """Entries with their route: region, bundle or copy."""
    small = filters.is_small_file(F.col("path"), F.col("length"), BUNDLED)
    is_region = F.col("path").rlike(r"(^|/)r\.-?\d+\.-?\d+\.mca$") & (F.col("length") > 0)
    return entries.withColumn("route", F.when(is_region, "region").when(small, "bundle").otherwise("copy"))


def split_regions(files: DataFrame) -> DataFrame:
    """The chunks of region files in two parts each; a file that can't be read is one row with the reason and its bytes."""

    def run(parts):
        for pdf in parts:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = []
                    for place, _, stamp, data in region.read_chunks(bytes(content)):
                        rest, version, sections = region.split_chunk(data)
                        rows.append((path, place, stamp, version, rest, [{"sy": sy, "palette": p, "ids": ids.astype("<u2").tobytes()} for sy, p, ids in sections], None))
                except Exception as error:  # noqa: BLE001 - what can't be read is kept as it is
                    rows = [(path, -1, 0, None, bytes(content), [], f"{type(error).__name__}: {error}")]
                yield pd.DataFrame(rows, columns=["path", "place", "stamp", "version", "rest", "sections", "failed"]).astype({"version": "Int32"})

    return files.select("path", "content").mapInPandas(run, _CHUNKS)


def not_empty(chunks: DataFrame) -> DataFrame:
    """The chunks that generation has brought to their surface or that hold something."""

    @F.pandas_udf("boolean")
    def empty(rest: pd.Series, version: pd.Series, sections: pd.Series) -> pd.Series:
        return pd.Series([not n and derived.is_empty(bytes(r), None if pd.isna(v) else int(v)) for r, v, n in zip(rest, version, sections, strict=True)])

    return chunks.filter(~empty("rest", "version", F.size("sections")))


def _held(sections) -> dict[int, tuple[list[str], np.ndarray]]:
    return {s["sy"]: (list(s["palette"]), np.frombuffer(s["ids"], "<u2").astype(np.int32)) for s in (sections if sections is not None else [])}


def cells_of(chunks: DataFrame) -> DataFrame:
    """(path, place, sy, i, x, y, z, block) of chunks (path, place, sections): coordinates within the region file."""

    def run(parts):
        i = np.arange(4096)
        for pdf in parts:
            for path, place, sections in zip(pdf["path"], pdf["place"], pdf["sections"], strict=True):
                for sy, (names, ids) in _held(sections).items():
                    at = {"x": place % 32 * 16 + (i & 15), "y": sy * 16 + (i >> 8), "z": place // 32 * 16 + (i >> 4 & 15)}
                    yield pd.DataFrame({"path": path, "place": place, "sy": sy, "i": i, **at, "block": np.array(names, object)[ids]})

    return chunks.filter(F.size("sections") > 0).select("path", "place", "sections").mapInPandas(run, _CELLS)


def sections_of(cells: DataFrame) -> DataFrame:
    """(path, place, sections) of cells, each section with a palette of its own."""
    lists = cells.groupBy("path", "place", "sy").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "block"))), lambda c: c["block"]).alias("states"))  # 4,096 of them

    @F.pandas_udf("struct<palette:array<string>,ids:binary>")
    def named(states: pd.Series) -> pd.DataFrame:
        own = [np.unique(np.asarray(s, str), return_inverse=True) for s in states]
        return pd.DataFrame({"palette": [p.tolist() for p, _ in own], "ids": [c.astype("<u2").tobytes() for _, c in own]})

    each = lists.select("path", "place", "sy", named("states").alias("own")).select("path", "place", F.struct("sy", "own.palette", "own.ids").alias("s"))
    return each.groupBy("path", "place").agg(F.sort_array(F.collect_list("s")).cast(_SECTIONS).alias("sections"))


def _blocks(pdf: pd.DataFrame) -> derived.Blocks:
    return derived.Blocks({a["block"]: tuple(a[k] for k in ("opacity", "emission", "motion", "fluid", "leaves")) for a in pdf["known"].iloc[0]})


def attribute_column(attributes: DataFrame | None) -> Column:
    """Block attributes (block, opacity, emission, motion, fluid, leaves) as one constant; a dimension of fewer than 65,535 states."""
    kind = "array<struct<block:string,opacity:int,emission:int,motion:boolean,fluid:boolean,leaves:boolean>>"
    rows = [] if attributes is None else attributes.select("block", "opacity", "emission", "motion", "fluid", "leaves").limit(palette.ID_LIMIT + 1).collect()
    if len(rows) > palette.ID_LIMIT:
        raise ValueError("attributes of more states than a palette can hold")
    return F.from_json(F.lit(json.dumps([r.asDict() for r in rows])), kind)


def stripped(chunks: DataFrame, known: Column, heights: bool, light: bool, upgrades: bool) -> DataFrame:
    """Chunks without what their cells let one compute; ``off`` holds the differences.  A region file is one task, as light crosses its chunks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {r.place: (bytes(r.rest), None if pd.isna(r.version) else int(r.version), _held(r.sections)) for r in pdf.itertuples(index=False) if r.place >= 0}
        found = derived.strip(own, _blocks(pdf), heights, light, upgrades)
        pdf["off"] = [found.get(p, (None, None))[1] for p in pdf["place"]]
        pdf["rest"] = [found[p][0] if p in found else r for p, r in zip(pdf["place"], pdf["rest"], strict=True)]
        return pdf.drop(columns="known")

    return chunks.withColumn("known", known).groupBy("path").applyInPandas(run, f"{_CHUNKS}, off binary")


def pack(spark: SparkSession, source: str, target: str, preset: str | Preset = "default", transforms: str | None = None, add_transforms: str | None = None, bundles: bool = True, attributes: DataFrame | None = None) -> None:
    """Packs a folder or zip file into tables below ``target``.

    ``transforms`` (a pipe as text) takes the place of the preset's, ``add_transforms`` comes after them.  Each region file is by
    itself.  Heights and light that aren't kept are computed from the cells and ``attributes`` of blocks (block, opacity,
    emission, motion, fluid, leaves) when the world is unpacked; where the chunk's own differ, the difference is stored.
    ``auto`` strips light only if attributes are given.
    """
    own = PRESETS[preset] if isinstance(preset, str) else preset
    pipe = Pipe.parse(own.transforms if transforms is None else transforms) + Pipe.parse(add_transforms or "")
    heights, light = (keep_or_strip(mode, attributes is not None) == "strip" for mode in (own.heights, own.light))
    entries = routed(archive.scan(spark, source))
    if not bundles:
        entries = entries.withColumn("route", F.when(F.col("route") == "bundle", "copy").otherwise(F.col("route")))
    split_regions(entries.filter("route = 'region'")).write.mode("overwrite").parquet(f"{target}/_chunks")
    chunks = spark.read.parquet(f"{target}/_chunks")
    if pipe.has(RemoveEmptyChunks):
        chunks = not_empty(chunks)
    if pipe.of_cells().steps:
        changed = sections_of(pipe.of_cells().apply(cells_of(chunks)).select("path", "place", "sy", "i", "block"))
        chunks = chunks.drop("sections").join(changed, ["path", "place"], "left").select("path", "place", "stamp", "version", "rest", "sections", "failed")
    known = attribute_column(attributes)
    if heights or light or pipe.has(SimplifyUpgradeData):
        chunks = stripped(chunks, known, heights, light, pipe.has(SimplifyUpgradeData))
    else:
        chunks = chunks.withColumn("off", F.lit(None).cast("binary"))
    chunks.write.mode("overwrite").parquet(f"{target}/_whole")
    chunks = spark.read.parquet(f"{target}/_whole")
    chunks.drop("sections").write.mode("overwrite").parquet(f"{target}/chunks")
    # numbers of states by their frequency, from the sections' palettes: no cell is a row
    each = chunks.select("path", "place", F.explode("sections").alias("s")).select("path", "place", "s.sy", "s.palette", "s.ids")
    names = palette.of_counts(_state_counts(each).groupBy("block").agg(F.sum("n").alias("n")))
    names.write.mode("overwrite").parquet(f"{target}/palette")
    numbers = each.select("path", "place", "sy", F.posexplode("palette").alias("k", "block")).join(spark.read.parquet(f"{target}/palette").select("block", "sym_id"), "block")
    numbers = numbers.groupBy("path", "place", "sy").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sym_id"))), lambda x: x["sym_id"]).alias("numbers"))
    blocks = each.drop("palette").join(numbers, ["path", "place", "sy"])
    if own.codec == "columns":
        blocks.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/blocks")
    else:
        cells = _numbered_cells(blocks)
        coded = codec.encode_regions(cells, "path", context_bits=own.context_bits, neighbours=own.neighbours) if own.codec == "ordered" else codec.encode_sections(cells, "path", level=own.level)
        coded.write.mode("overwrite").parquet(f"{target}/blocks")
    small = entries.filter("route = 'bundle'").withColumn("folder", F.regexp_extract("path", r"^(.*/)?", 1))
    placed = bundle.next_fit(small.select("path", "length", "content", "folder"), "length", "path", "folder").withColumn("bundle", F.xxhash64("folder", "bundle"))
    bundle.pack_bundles(placed).write.mode("overwrite").parquet(f"{target}/bundles")
    filters.metadata_dropped(entries.filter("route = 'copy'"), OWN_FOLDER).select("path", "content").write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/copies")
    spark.range(1).select(known.alias("known")).write.mode("overwrite").parquet(f"{target}/attributes")
    registry.write_metadata(spark, f"{target}/metadata", VERSION, VERSION, [own.codec, own.transforms if transforms is None else transforms, add_transforms or ""])
    for part in ("_chunks", "_whole"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{part}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _state_counts(sections: DataFrame) -> DataFrame:
    """(block, n) of each section (palette, ids)."""

    def run(parts):
        for pdf in parts:
            total: dict[str, int] = {}
            for names, ids in zip(pdf["palette"], pdf["ids"], strict=True):
                for name, n in zip(names, np.bincount(np.frombuffer(ids, "<u2"), minlength=len(names)).tolist(), strict=True):
                    total[name] = total.get(name, 0) + n
            yield pd.DataFrame({"block": list(total), "n": list(total.values())})

    return sections.select("palette", "ids").mapInPandas(run, "block string, n long").filter("n > 0")


def _numbered_cells(blocks: DataFrame) -> DataFrame:
    """(path, x, y, z, sym_id) of sections (path, place, sy, ids, numbers); ids of states count from 1."""

    def run(parts):
        i = np.arange(4096)
        for pdf in parts:
            for path, place, sy, ids, numbers in zip(pdf["path"], pdf["place"], pdf["sy"], pdf["ids"], pdf["numbers"], strict=True):
                own = np.asarray(numbers, np.int64)[np.frombuffer(ids, "<u2")] + 1
                yield pd.DataFrame({"path": path, "x": place % 32 * 16 + (i & 15), "y": sy * 16 + (i >> 8), "z": place // 32 * 16 + (i >> 4 & 15), "sym_id": own})

    return blocks.select("path", "place", "sy", "ids", "numbers").mapInPandas(run, "path string, x long, y long, z long, sym_id int")


def _packed_sections(spark: SparkSession, target: str, kind: str) -> DataFrame:
    """(path, place, sections) of a packed world's blocks."""
    blocks, names = (spark.read.parquet(f"{target}/{t}") for t in ("blocks", "palette"))
    if kind == "columns":
        states = blocks.select("path", "place", "sy", F.posexplode("numbers").alias("k", "sym_id")).join(names.select("sym_id", "block"), "sym_id")
        states = states.groupBy("path", "place", "sy").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "block"))), lambda x: x["block"]).alias("palette"))
        each = blocks.select("path", "place", "sy", "ids").join(states, ["path", "place", "sy"]).select("path", "place", F.struct("sy", "palette", "ids").alias("s"))
        return each.groupBy("path", "place").agg(F.sort_array(F.collect_list("s")).cast(_SECTIONS).alias("sections"))
    cells = (codec.decode_regions if kind == "ordered" else codec.decode_sections)(blocks, "path").filter("sym_id > 0").withColumn("sym_id", F.col("sym_id") - 1)
    place = (F.floor(F.col("x") / 16) + F.floor(F.col("z") / 16) * 32).cast("int")
    index = F.shiftleft(F.pmod("y", F.lit(16)).cast("int"), 8).bitwiseOR(F.shiftleft(F.pmod("z", F.lit(16)).cast("int"), 4)).bitwiseOR(F.pmod("x", F.lit(16)).cast("int"))
    cells = cells.select("path", place.alias("place"), F.floor(F.col("y") / 16).cast("int").alias("sy"), index.alias("i"), "sym_id")
    return sections_of(cells.join(names.select("sym_id", "block"), "sym_id"))


def unpacked_regions(spark: SparkSession, target: str) -> DataFrame:
    """(path, content) of the region files of a packed world, with heights and light computed again."""
    kind, *steps = registry.read_metadata(spark, f"{target}/metadata", VERSION)["transforms"]
    upgrades = any(Pipe.parse(s).has(SimplifyUpgradeData) for s in steps)  # names that the registry doesn't know fail
    chunks = spark.read.parquet(f"{target}/chunks")
    known = spark.read.parquet(f"{target}/attributes")  # one row
    whole = chunks.join(_packed_sections(spark, target, kind), ["path", "place"], "left").crossJoin(known)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        path = pdf["path"].iloc[0]
        if pdf["place"].iloc[0] < 0:
            return pd.DataFrame({"path": [path], "content": [bytes(pdf["rest"].iloc[0])]})
        own = {r.place: (bytes(r.rest), None if pd.isna(r.version) else int(r.version), _held(r.sections), r.off) for r in pdf.itertuples(index=False)}
        rests = derived.restore(own, _blocks(pdf), upgrades)
        out = {p: region.join_chunk(rests[p], version, [(sy, *s) for sy, s in sorted(sections.items())]) for p, (_, version, sections, _) in own.items()}
        return pd.DataFrame({"path": [path], "content": [region.write_region(out, dict(zip(pdf["place"], pdf["stamp"], strict=True)))]})

    return whole.groupBy("path").applyInPandas(run, "path string, content binary")


def unpacked(spark: SparkSession, target: str) -> DataFrame:
    """(path, content) of every file of a packed world."""
    bundles = bundle.unpack_bundles(spark.read.parquet(f"{target}/bundles"))
    return unpacked_regions(spark, target).unionByName(bundles).unionByName(spark.read.parquet(f"{target}/copies"))


def unpack(spark: SparkSession, target: str, folder: str) -> int:
    """Writes a packed world's files below a folder that all executors share; gives their number."""
    return region.write_files(unpacked(spark, target), folder)


def dump(spark: SparkSession, source: str, kind: str = "print", with_blocks: bool = True) -> DataFrame:
    """What files hold, for a look: print (text of documents), variant (documents), chunks (ids of sections), blocks (cells)."""
    from gridloom.sources import nbt

    entries = archive.scan(spark, source)
    chunks = region.chunks_of(routed(entries).filter("route = 'region'").select("path", "content"))
    if kind == "chunks":
        return region.section_rows(chunks)
    if kind == "blocks":
        return region.cells_of(region.section_rows(chunks))
    if kind not in ("print", "variant"):
        raise ValueError(f"unknown kind {kind!r}")
    documents = entries.filter(extension(F.col("path")).isin(".dat", ".nbt", ".dat_old")).select("path", F.col("content").alias("data")).unionByName(chunks.select("path", "data"))
    if not with_blocks:

        @F.pandas_udf("binary")
        def bare(data: pd.Series) -> pd.Series:
            return data.map(lambda d: region.split_chunk(bytes(d), keep_light=False)[0] if bytes(d[:1]) == b"\x0a" else d)

        documents = documents.withColumn("data", bare("data"))
    return documents.select("path", (nbt.to_text("data") if kind == "print" else nbt.to_variant(F.col("data"))).alias("value"))
