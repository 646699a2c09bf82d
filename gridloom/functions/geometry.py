"""Grid coordinates, direction masks, light words and box shapes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A bit for each direction, and its offset.
DIRECTIONS = {"XNeg": 1, "XPos": 2, "ZNeg": 4, "ZPos": 8, "YNeg": 16, "YPos": 32}
OFFSETS = {"XNeg": (-1, 0, 0), "XPos": (1, 0, 0), "ZNeg": (0, 0, -1), "ZPos": (0, 0, 1), "YNeg": (0, -1, 0), "YPos": (0, 1, 0)}
#: The factor, of 255, of each shade of a map colour.
SHADES = (180, 220, 255, 135)


def cell_index(x: Column, y: Column, z: Column) -> Column:
    """The place of a cell in its section of 16 cells a side: x fastest, then z, then y."""
    return F.shiftleft(y.bitwiseAND(15), 8).bitwiseOR(F.shiftleft(z.bitwiseAND(15), 4)).bitwiseOR(x.bitwiseAND(15)).cast("int")


def chunk_index(cx: Column, cz: Column) -> Column:
    """The place of a chunk in its region of 32 chunks a side."""
    return (cx.bitwiseAND(31) + cz.bitwiseAND(31) * 32).cast("int")


def dump_index(x: Column, y: Column, z: Column, side: int = 512) -> Column:
    return (y.cast("long") * side + z) * side + x


def sector_pack(sector: Column, count: Column) -> Column:
    return F.shiftleft(sector.cast("long"), 8).bitwiseOR(count.cast("long").bitwiseAND(255))


def sector_of(location: Column) -> Column:
    return F.shiftright(location, 8)


def sector_count(location: Column) -> Column:
    return location.bitwiseAND(255)


def sectors_needed(size: Column) -> Column:
    """Sectors of 4,096 bytes."""
    return F.ceil(size / 4096).cast("long")


def vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def vector_add(a: Column, b: Column) -> Column:
    return vector(*(a[k] + b[k] for k in "xyz"))


def vector_scale(a: Column, n: Column) -> Column:
    return vector(*(a[k] * n for k in "xyz"))


def opposite(mask: Column) -> Column:
    """Each direction of a mask turned round: neighbouring bits change places."""
    return F.shiftleft(mask.bitwiseAND(21), 1).bitwiseOR(F.shiftright(mask.bitwiseAND(42), 1))


def axis_of(mask: Column) -> Column:
    """X, Z or Y of a single direction."""
    return F.when(mask.bitwiseAND(3) != 0, "X").when(mask.bitwiseAND(12) != 0, "Z").when(mask.bitwiseAND(48) != 0, "Y")


def remap_mask(mask: Column, table: dict[int, int]) -> Column:
    """Bits of one enumeration as bits of another."""
    out = F.lit(0)
    for old, new in table.items():
        out = out.bitwiseOR(F.when(mask.bitwiseAND(old) != 0, new).otherwise(0))
    return out


def light_word(opacity: Column, emission: Column, shape: Column) -> Column:
    """opacity in bits 0 to 3, shape from bit 4, emission from bit 12."""
    return opacity.bitwiseAND(15).bitwiseOR(F.shiftleft(emission.bitwiseAND(15), 12)).bitwiseOR(F.shiftleft(shape, 4))


def light_parts(word: Column) -> Column:
    return F.struct(word.bitwiseAND(15).alias("opacity"), F.shiftright(word, 12).bitwiseAND(15).alias("emission"), F.shiftright(word, 4).bitwiseAND(255).alias("shape"))


def registry_light(packed: Column) -> Column:
    """(emission, opacity) of emission << 4 | opacity."""
    return F.struct(F.shiftright(packed, 4).alias("emission"), packed.bitwiseAND(15).alias("opacity"))


def shaded(rgb: Column, shade: Column) -> Column:
    """An opaque ARGB colour of a base colour in one of four shades."""
    factor = F.element_at(F.array(*map(F.lit, SHADES)), shade + 1)

    def part(shift: int) -> Column:
        return F.shiftleft(F.floor(F.shiftright(rgb, shift).bitwiseAND(255) * factor / 255).cast("long"), shift)

    return F.lit(0xFF000000).cast("long").bitwiseOR(part(16)).bitwiseOR(part(8)).bitwiseOR(part(0))


def _face(boxes: np.ndarray, axis: int, side: int) -> np.ndarray:
    """The 16 by 16 raster of what boxes (x1, y1, z1, x2, y2, z2) cover of one face of the cube."""
    grid = np.zeros((16, 16), bool)
    u, v = (a for a in range(3) if a != axis)
    for b in boxes:
        if b[axis + 3] == 16 if side else b[axis] == 0:
            grid[b[u] : b[u + 3], b[v] : b[v + 3]] = True
    return grid


def _shadow(boxes: np.ndarray, axis: int) -> np.ndarray:
    grid = np.zeros((16, 16), bool)
    u, v = (a for a in range(3) if a != axis)
    for b in boxes:
        grid[b[u] : b[u + 3], b[v] : b[v + 3]] = True
    return grid


def hidden_directions(a: list, b: list, *, full_axis: bool = False) -> int:
    """The mask of directions in which light from a cell of shape ``a`` to its neighbour of shape ``b`` is stopped.

    The faces that touch - that of a in the direction, that of b opposite - cover the whole square together; with
    ``full_axis``, the whole shapes seen along the axis do.
    """
    boxes = [np.asarray(x, int).reshape(-1, 6) for x in (a, b)]
    mask = 0
    for name, bit in DIRECTIONS.items():
        axis, side = "XYZ".index(name[0]), name.endswith("Pos")
        if full_axis:
            grid = _shadow(boxes[0], axis) | _shadow(boxes[1], axis)
        else:
            grid = _face(boxes[0], axis, side) | _face(boxes[1], axis, not side)
        if grid.all():
            mask |= bit
    return mask


@F.pandas_udf(T.IntegerType())
def occlusion_mask(a: pd.Series, b: pd.Series) -> pd.Series:
    """hidden_directions() of two columns of box arrays (array<array<int>>); each pair of shapes of a batch is worked out once."""
    seen: dict[tuple, int] = {}
    out = []
    for x, y in zip(a, b, strict=True):
        key = tuple(map(tuple, x)), tuple(map(tuple, y))
        if key not in seen:
            seen[key] = hidden_directions(list(key[0]), list(key[1]))
        out.append(seen[key])
    return pd.Series(out)
