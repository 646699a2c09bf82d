"""Region files: 32 by 32 chunks behind a table of sectors."""

from __future__ import annotations

import gzip
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.bits import pack_bits, unpack_bits
from gridloom.sources import nbt

#: Bytes of a sector, the codecs' numbers, the first version whose packed values don't span words.
SECTOR, GZIP, ZLIB, RAW, SPARSE_VERSION = 4096, 1, 2, 3, 2529
#: The blocks of the material air.
AIRS = ("air", "cave_air", "void_air")
_NAME = re.compile(r"(?:^|/)r\.(-?\d+)\.(-?\d+)\.mca$")
CHUNKS = "path string, cx int, cz int, codec int, stamp long, data binary"


def read_chunks(content: bytes):
    """(place, codec, time, payload) of each chunk, by its location."""
    if len(content) < 2 * SECTOR:
        return
    table = np.frombuffer(content, ">u4", 2048).astype(np.int64)
    location, stamp = table[:1024], table[1024:]
    for i in sorted(np.flatnonzero(location).tolist(), key=lambda k: int(location[k])):
        at = int(location[i] >> 8) * SECTOR
        if at + 5 > len(content):
            raise ValueError(f"chunk {i} lies outside the file")
        size, codec = struct.unpack_from(">iB", content, at)
        data = content[at + 5 : at + 4 + size]
        if codec == GZIP:
            data = gzip.decompress(data)
        elif codec == ZLIB:
            data = zlib.decompress(data)
        elif codec != RAW:
            raise ValueError(f"chunk {i} has an unknown codec {codec}")
        yield i, codec, int(stamp[i]), data


def write_region(chunks: dict[int, bytes], stamps: dict[int, int] | None = None, codec: int = ZLIB) -> bytes:
    """A region file of chunks by place; each is written once, on whole sectors.

    The table's byte holds up to 255 sectors; a longer chunk has 255 there and its size in its own header, where read_chunks() takes it from.
    Programs that go by the table alone can't read such a chunk.
    """
    table, body, at = np.zeros(2048, np.int64), [], 2
    for i in sorted(chunks):
        data = {GZIP: lambda d: gzip.compress(d, 6, mtime=0), ZLIB: lambda d: zlib.compress(d, 6), RAW: bytes}[codec](chunks[i])
        raw = struct.pack(">iB", len(data) + 1, codec) + data
        sectors = -(-len(raw) // SECTOR)
        body.append(raw.ljust(sectors * SECTOR, b"\0"))
        table[i], table[1024 + i] = at << 8 | min(sectors, 255), (stamps or {}).get(i, 0)
        at += sectors
    return table.astype(">u4").tobytes() + b"".join(body)


def region_of(path: str) -> tuple[int, int]:
    found = _NAME.search(path.replace("\\", "/"))
    if not found:
        raise ValueError(f"not a region file: {path}")
    return int(found[1]), int(found[2])


def scan_regions(spark: SparkSession, path: str) -> DataFrame:
    """(path, cx, cz, codec, stamp, data) of every chunk of the region files below a folder; read by Spark's own readers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mca").load(path).select("path", "content")
    return chunks_of(files)


def chunks_of(files: DataFrame) -> DataFrame:
    """The chunks of files (path, content), one task for some files."""

    def run(parts):
        for pdf in parts:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rx, rz = region_of(path)
                rows = [(path, rx * 32 + i % 32, rz * 32 + i // 32, codec, stamp, data) for i, codec, stamp, data in read_chunks(bytes(content))]
                yield pd.DataFrame(rows, columns=["path", "cx", "cz", "codec", "stamp", "data"])

    return files.mapInPandas(run, CHUNKS)


def region_files(chunks: DataFrame) -> DataFrame:
    """(path, content) from chunks (cx, cz, stamp, data): a file for each region, which holds 1,024 chunks at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place = (pdf["cx"] % 32 + pdf["cz"] % 32 * 32).tolist()
        content = write_region(dict(zip(place, map(bytes, pdf["data"]), strict=True)), dict(zip(place, pdf["stamp"], strict=True)))
        return pd.DataFrame({"path": [f"r.{pdf['rx'].iloc[0]}.{pdf['rz'].iloc[0]}.mca"], "content": [content]})

    own = chunks.select(F.floor(F.col("cx") / 32).cast("int").alias("rx"), F.floor(F.col("cz") / 32).cast("int").alias("rz"), "cx", "cz", "stamp", "data")
    return own.groupBy("rx", "rz").applyInPandas(run, "path string, content binary")


def write_files(files: DataFrame, folder: str) -> int:
    """Writes (path, content) below a folder that all executors share; a path may not leave it.  Gives the number of files."""
    import os

    def run(parts):
        n = 0
        root = os.path.realpath(folder)
        for pdf in parts:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                to = os.path.realpath(os.path.join(root, path))
                if os.path.commonpath([root, to]) != root or to == root:
                    raise ValueError(f"{path} lies outside the folder")
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with open(to + ".tmp", "wb") as f:
                    f.write(bytes(content))
                os.replace(to + ".tmp", to)
                n += 1
        yield pd.DataFrame({"n": [n]})

    return files.select("path", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


# -- chunks as sections of cells --


def section_states(data: bytes) -> list[tuple[int, int, int, list[str], np.ndarray]]:
    """(cx, cz, sy, palette, ids) of a chunk's sections; none of a chunk without Level, and none of a section of air alone."""
    root = nbt.read(data)[1][1]
    if "Level" not in root:
        return []
    version = root.get("DataVersion", (nbt.INT, 0))[1]
    level = root["Level"][1]
    cx, cz, out = level["xPos"][1], level["zPos"][1], []
    for section in level.get("Sections", (nbt.LIST, (nbt.COMPOUND, [])))[1][1]:
        sy = section_height(section)
        if "Palette" in section and "BlockStates" in section:
            palette = [state_text(p) for p in section["Palette"][1][1]]
            if palette and not (len(palette) == 1 and is_air(palette[0])):
                bits = max(4, (len(palette) - 1).bit_length())
                words = np.asarray(section["BlockStates"][1]).astype(np.int64).view(np.uint64)
                out.append((cx, cz, sy, palette, unpack_bits(words, bits, 4096, spanning=version < SPARSE_VERSION).astype(np.int32)))
        elif "Blocks" in section:
            ids = legacy_ids(section)
            seen, codes = np.unique(ids, return_inverse=True)
            out.append((cx, cz, sy, [f"{s >> 4}:{s & 15}" for s in seen.tolist()], codes.astype(np.int32)))
    return out


def section_height(section: dict) -> int:
    """The height of a section, in sections; the format's byte holds -128 to 127, others are ints (height_tag)."""
    kind, sy = section["Y"]
    return sy - 256 * (kind == nbt.BYTE and sy > 127)


def height_tag(sy: int) -> nbt.Tag:
    return (nbt.BYTE, sy & 255) if -128 <= sy <= 127 else (nbt.INT, sy)


def is_air(state: str) -> bool:
    """Whether a state's block is one of the airs."""
    return state.partition("[")[0].removeprefix("minecraft:") in AIRS


def legacy_ids(section: dict) -> np.ndarray:
    """block << 4 | data of each cell, with the block's high bits from Add."""
    block = np.frombuffer(section["Blocks"][1], np.uint8).astype(np.int32)

    def nibbles(name: str) -> np.ndarray:
        if name not in section:
            return np.zeros(4096, np.int32)
        raw = np.frombuffer(section[name][1], np.uint8)
        return np.stack([raw & 15, raw >> 4], axis=1).ravel().astype(np.int32)

    return block << 4 | nibbles("Data") | nibbles("Add") << 12


def state_text(entry: dict) -> str:
    name = entry["Name"][1]
    props = sorted((k, v[1]) for k, v in entry.get("Properties", (nbt.COMPOUND, {}))[1].items())
    return f"{name}[{','.join(f'{k}={v}' for k, v in props)}]" if props else name


#: Bits of a height in its packed words, columns of a chunk.
HEIGHT_BITS, COLUMNS = 9, 256


def height_values(data: bytes) -> list[tuple[int, int, str, np.ndarray]]:
    """(cx, cz, kind, heights of the columns, x fastest) of a chunk's heightmaps: packed words by kind, or the plain list of old versions."""
    root = nbt.read(data)[1][1]
    if "Level" not in root:
        return []
    version, level = root.get("DataVersion", (nbt.INT, 0))[1], root["Level"][1]
    cx, cz = level["xPos"][1], level["zPos"][1]
    out = [(cx, cz, kind, unpack_bits(np.asarray(words).astype(np.int64).view(np.uint64), HEIGHT_BITS, COLUMNS, spanning=version < SPARSE_VERSION).astype(np.int32)) for kind, (_, words) in level.get("Heightmaps", (nbt.COMPOUND, {}))[1].items()]
    if "HeightMap" in level and len(level["HeightMap"][1]) == COLUMNS:
        out.append((cx, cz, "LEGACY", np.asarray(level["HeightMap"][1], np.int32)))
    return out


def height_tags(heights: dict[str, np.ndarray], version: int) -> dict:
    """The inverse of height_values(): the tags of a chunk's level."""
    packed = {kind: (nbt.LONGS, pack_bits(h, HEIGHT_BITS, spanning=version < SPARSE_VERSION).view(np.int64)) for kind, h in heights.items() if kind != "LEGACY"}
    out = {"Heightmaps": (nbt.COMPOUND, packed)} if packed else {}
    return out | ({"HeightMap": (nbt.INTS, np.asarray(heights["LEGACY"], np.int32))} if "LEGACY" in heights else {})


def height_rows(chunks: DataFrame) -> DataFrame:
    """(cx, cz, kind, heights) of chunks (data)."""

    def run(parts):
        for pdf in parts:
            rows = [(a, b, k, h.tolist()) for d in pdf["data"] for a, b, k, h in height_values(bytes(d))]
            yield pd.DataFrame(rows, columns=["cx", "cz", "kind", "heights"])

    return chunks.select("data").mapInPandas(run, "cx int, cz int, kind string, heights array<int>")


def state_entry(text: str) -> dict:
    name, _, rest = text.partition("[")
    out = {"Name": name}
    if rest:
        out["Properties"] = dict(x.split("=", 1) for x in rest.rstrip("]").split(","))
    return out


def chunk_document(cx: int, cz: int, version: int, sections: dict[int, list[str]]) -> bytes:
    """A chunk from the states of its sections' cells, each with a palette of its own by first sight."""
    out = []
    for sy, cells in sorted(sections.items()):
        palette: dict[str, int] = {}
        ids = np.array([palette.setdefault(s, len(palette)) for s in cells], np.uint64)
        bits = max(4, (len(palette) - 1).bit_length())
        words = pack_bits(ids, bits, spanning=version < SPARSE_VERSION).view(np.int64)
        out.append({"Y": height_tag(sy), "Palette": nbt.of([state_entry(s) for s in palette]), "BlockStates": (nbt.LONGS, words)})
    level = {"xPos": (nbt.INT, cx), "zPos": (nbt.INT, cz), "Sections": (nbt.LIST, (nbt.COMPOUND, out))}
    return nbt.write((nbt.COMPOUND, {"DataVersion": (nbt.INT, version), "Level": (nbt.COMPOUND, level)}))


def section_rows(chunks: DataFrame) -> DataFrame:
    """(cx, cz, sy, palette, ids) of chunks (data)."""

    def run(parts):
        for pdf in parts:
            rows = [r for d in pdf["data"] for r in section_states(bytes(d))]
            yield pd.DataFrame([(a, b, s, p, i.tolist()) for a, b, s, p, i in rows], columns=["cx", "cz", "sy", "palette", "ids"])

    return chunks.select("data").mapInPandas(run, "cx int, cz int, sy int, palette array<string>, ids array<int>")


def cells_of(sections: DataFrame) -> DataFrame:
    """(x, y, z, block) of sections in long form."""
    cell = sections.select("cx", "cz", "sy", "palette", F.posexplode("ids").alias("i", "id"))
    return cell.select((F.col("cx") * 16 + F.col("i").bitwiseAND(15)).cast("int").alias("x"), (F.col("sy").cast("long") * 16 + F.shiftright("i", 8)).alias("y"), (F.col("cz").cast("long") * 16 + F.shiftright("i", 4).bitwiseAND(15)).alias("z"), F.element_at("palette", F.col("id") + 1).alias("block"))


# -- chunks in two parts: what this library reads, and the rest as it was --

_BLOCK_KEYS = ("Palette", "BlockStates", "Blocks", "Data", "Add")
_LIGHT_KEYS = ("SkyLight", "BlockLight")


def split_chunk(data: bytes, keep_light: bool = True, keep_heights: bool = True) -> tuple[bytes, int | None, list]:
    """(the document without its cells, its version, its sections (sy, palette, ids)); a chunk without Level stays whole."""
    name, (kind, root) = nbt.read(data)
    if "Level" not in root:
        return data, None, []
    version = root.get("DataVersion", (nbt.INT, 0))[1]
    found = [(sy, palette, ids) for _, _, sy, palette, ids in section_states(data)]
    held = {sy for sy, _, _ in found}
    level = dict(root["Level"][1])
    sections = []
    for section in level.get("Sections", (nbt.LIST, (nbt.COMPOUND, [])))[1][1]:
        sy = section_height(section)
        drop = (_BLOCK_KEYS if sy in held else ()) + (() if keep_light else _LIGHT_KEYS)
        sections.append({k: v for k, v in section.items() if k not in drop})
    if "Sections" in level:
        level["Sections"] = (nbt.LIST, (nbt.COMPOUND, sections))
    if not keep_heights:
        level.pop("Heightmaps", None)
    return nbt.write((kind, root | {"Level": (nbt.COMPOUND, level)}), name), version, found


def join_chunk(rest: bytes, version: int | None, sections: list) -> bytes:
    """The inverse of split_chunk(); cells that the rest has itself stay."""
    if version is None or not sections:
        return rest
    name, (kind, root) = nbt.read(rest)
    level = dict(root["Level"][1])
    new = {sy: _section_tags(palette, np.asarray(ids), version) for sy, palette, ids in sections}
    out = []
    for section in level.get("Sections", (nbt.LIST, (nbt.COMPOUND, [])))[1][1]:
        sy = section_height(section)
        out.append(new.pop(sy, {}) | section)
    out += [{"Y": height_tag(sy)} | tags for sy, tags in sorted(new.items())]
    level["Sections"] = (nbt.LIST, (nbt.COMPOUND, out))
    return nbt.write((kind, root | {"Level": (nbt.COMPOUND, level)}), name)


def _section_tags(palette: list[str], ids: np.ndarray, version: int) -> dict:
    """Cells as tags: ids and nibbles if all states are legacy (``id:data``), else a palette by first sight and packed words; a section can't hold both."""
    legacy = [bool(re.fullmatch(r"\d+:\d+", s)) for s in palette]
    if any(legacy) and not all(legacy):
        raise ValueError(f"a section of old numbers can't hold {palette[legacy.index(False)]!r}")
    if all(legacy):
        state = np.array([int(a) << 4 | int(b) for a, b in (s.split(":") for s in palette)], np.int32)[ids]
        nibbles = {"Data": state & 15, "Add": state >> 12}
        tags = {"Blocks": (nbt.BYTES, (state >> 4 & 255).astype(np.uint8).tobytes())}
        for key, v in nibbles.items():
            if key == "Data" or v.any():
                tags[key] = (nbt.BYTES, (v[0::2] | v[1::2] << 4).astype(np.uint8).tobytes())
        return tags
    seen, first = np.unique(ids, return_index=True)
    order = seen[np.argsort(first)]
    number = np.zeros(int(ids.max()) + 1, np.int64)
    number[order] = np.arange(len(order))
    bits = max(4, (len(order) - 1).bit_length())
    words = pack_bits(number[ids], bits, spanning=version < SPARSE_VERSION).view(np.int64)
    return {"Palette": nbt.of([state_entry(palette[i]) for i in order.tolist()]), "BlockStates": (nbt.LONGS, words)}
