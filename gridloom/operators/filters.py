"""Predicates over chunks, blocks and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attribute bits of a block.
OPAQUE, TRANSLUCENT, FULL_CUBE = 1, 2, 4
#: Chunk states in the order in which they are reached.
STATUSES = ("empty", "structure_starts", "structure_references", "biomes", "noise", "surface", "carvers", "liquid_carvers", "features", "light", "spawn", "heightmaps", "full")
#: The first version whose chunks have such states.
STATUS_VERSION = 1976
#: The largest file that is bundled, in bytes.
SMALL_FILE = 128 * 1024


def existing(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def has_all(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(mask) == mask


def is_opaque(flags: Column) -> Column:
    """Opaque and a full cube, and not translucent."""
    return flags.bitwiseAND(OPAQUE | TRANSLUCENT | FULL_CUBE) == OPAQUE | FULL_CUBE


def list_empty(values: Column) -> Column:
    """Null, without elements, or a list of lists that are all empty."""
    return values.isNull() | (F.size(values) == 0)


def nested_empty(values: Column) -> Column:
    return values.isNull() | F.forall(values, lambda x: x.isNull() | (F.size(x) == 0))


def structures_empty(starts: Column) -> Column:
    """No structure starts (a map of them) but those that are null."""
    return starts.isNull() | (F.size(F.map_filter(starts, lambda _, v: v.isNotNull())) == 0)


def is_empty_chunk(version: Column, status: Column, lists: list[Column], nested: list[Column], starts: Column) -> Column:
    """A chunk that generation hasn't brought to its surface and that holds nothing."""
    early = (F.array_position(F.array(*map(F.lit, STATUSES)), status) > 0) & (F.array_position(F.array(*map(F.lit, STATUSES)), status) <= STATUSES.index("surface"))
    held = structures_empty(starts)
    for x in lists:
        held = held & list_empty(x)
    for x in nested:
        held = held & nested_empty(x)
    return (version >= STATUS_VERSION) & early & held


def remove_empty_chunks(chunks: DataFrame, *rules) -> DataFrame:
    return chunks.filter(~F.coalesce(is_empty_chunk(*rules), F.lit(False)))


def on_edge(x: Column, z: Column, last: int = 15) -> Column:
    return x.isin(0, last) | z.isin(0, last)


def upgradeable(name: Column, names: list[str], namespace: str = "minecraft") -> Column:
    """A block of the namespace whose path is in a list."""
    from gridloom.functions.names import resource_namespace, resource_path

    return (resource_namespace(name) == namespace) & resource_path(name).isin(names)


def predicted_indices(cells: DataFrame, upgrade: Column) -> DataFrame:
    """(section, index) of cells that upgrading is expected to touch: not on a section's edge, and of an upgradeable block."""
    return cells.filter(upgrade & ~on_edge(F.col("x") % 16, F.col("z") % 16))


def is_small_file(path: Column, size: Column, extensions: list[str]) -> Column:
    """A file for a bundle: of a listed extension, at most 128 KiB, and not the world's main file."""
    from gridloom.functions.names import extension

    base = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    return extension(path).isin(extensions) & (size <= SMALL_FILE) & (base != "level.dat")


def metadata_dropped(entries: DataFrame, folder: str) -> DataFrame:
    """Entries outside the container's own folder."""
    return entries.filter(~F.col("path").startswith(folder.rstrip("/") + "/"))


def valid_neighbour(x: Column, y: Column, z: Column) -> Column:
    """An offset of at most 12 cells that points at one coded before: y below, or the same y and z before, or x before in the same row."""
    near = (F.abs(x) <= 12) & (F.abs(y) <= 12) & (F.abs(z) <= 12)
    return near & ((y < 0) | ((y == 0) & (z < 0)) | ((y == 0) & (z == 0) & (x < 0)))


def checked(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows, failing when read where the condition doesn't hold."""
    return df.filter(F.assert_true(F.coalesce(condition, F.lit(False)), F.lit(message)).isNull())


def whitelisted(df: DataFrame, names: DataFrame, column: str = "block") -> DataFrame:
    return df.join(names, column, "left_semi")


def height_predicates(states: DataFrame) -> DataFrame:
    """States (flags, material flags as booleans: motion, fluid, leaves, air) with a column for each heightmap kind."""
    motion, fluid, leaves, air = (F.col(k) for k in ("motion", "fluid", "leaves", "air"))
    kinds = {
        "WORLD_SURFACE": ~air, "WORLD_SURFACE_WG": ~air, "OCEAN_FLOOR": motion, "OCEAN_FLOOR_WG": motion,
        "MOTION_BLOCKING": motion | fluid, "MOTION_BLOCKING_NO_LEAVES": (motion | fluid) & ~leaves,
        "LIGHT_BLOCKING": F.col("opacity") > 0, "LEGACY": F.col("opacity") > 0,
    }
    return states.select("*", *(v.alias(k) for k, v in kinds.items()))


def by_version(version: Column, ranges: list[tuple[int, int, str]], otherwise: str = "passthrough") -> Column:
    """The name of the range (first, last, name) that a version lies in."""
    out = None
    for first, last, name in ranges:
        hit = version.between(first, last)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)
