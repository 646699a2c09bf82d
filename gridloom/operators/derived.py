"""What a chunk holds besides its cells and what its cells let one compute: heights, light, upgrade indices.

Computed values are predictions.  What is stored is where they differ from the chunk's own, so nothing is lost, and
little is stored where the attributes of blocks are known.  Everything here works on one region at a time, in numpy.
"""

from __future__ import annotations

import zlib

import numpy as np

from gridloom.operators.light import flood
from gridloom.sources import nbt, region

#: Paths of the blocks that an upgrade of old chunks touches.
UPGRADEABLE = tuple(
    """
    chest trapped_chest note_block red_bed fire oak_stairs stone_stairs cobblestone_stairs brick_stairs stone_brick_stairs nether_brick_stairs
    sandstone_stairs spruce_stairs birch_stairs jungle_stairs quartz_stairs acacia_stairs dark_oak_stairs red_sandstone_stairs purpur_stairs
    redstone_wire oak_fence nether_brick_fence spruce_fence birch_fence jungle_fence dark_oak_fence acacia_fence repeater iron_bars glass_pane
    white_stained_glass_pane orange_stained_glass_pane magenta_stained_glass_pane light_blue_stained_glass_pane yellow_stained_glass_pane
    lime_stained_glass_pane pink_stained_glass_pane gray_stained_glass_pane light_gray_stained_glass_pane cyan_stained_glass_pane
    purple_stained_glass_pane blue_stained_glass_pane brown_stained_glass_pane green_stained_glass_pane red_stained_glass_pane
    black_stained_glass_pane vine oak_fence_gate spruce_fence_gate birch_fence_gate jungle_fence_gate dark_oak_fence_gate acacia_fence_gate
    tripwire cobblestone_wall chorus_plant
    """.split()
)
#: Chunks a side of a block that is lit at once, without a rim of one chunk.
_LIT = 4
Sections = dict[int, tuple[list[str], np.ndarray]]  # by height: palette, ids


class Blocks:
    """Attributes of states (opacity, emission, motion, fluid, leaves); what isn't known is air by its name, else solid and opaque."""

    def __init__(self, known: dict[str, tuple[int, int, bool, bool, bool]] | None = None):
        self.known = known or {}

    def of(self, state: str) -> tuple[int, int, bool, bool, bool]:
        name = state.partition("[")[0]
        for key in (state, name, name.removeprefix("minecraft:")):
            if key in self.known:
                return self.known[key]
        return (0, 0, False, False, False) if region.is_air(state) or state.startswith("0:") else (15, 0, True, False, False)

    def stops(self, state: str, kind: str) -> bool:
        """Whether a block counts for a kind of heights."""
        opacity, _, motion, fluid, leaves = self.of(state)
        kind = kind.removesuffix("_WG")
        if kind == "WORLD_SURFACE":
            return not region.is_air(state)
        if kind == "OCEAN_FLOOR":
            return motion
        if kind in ("MOTION_BLOCKING", "MOTION_BLOCKING_NO_LEAVES"):
            return (motion or fluid) and not (leaves and kind.endswith("LEAVES"))
        return opacity > 0


def heights_of(sections: Sections, kind: str, blocks: Blocks) -> np.ndarray:
    """One more than the highest cell that counts for the kind in each column of a chunk, 0 if none does."""
    out = np.zeros(256, np.int32)
    for sy, (palette, ids) in sections.items():
        if sy >= 0:
            hit = np.array([blocks.stops(s, kind) for s in palette])[ids].reshape(16, 256)
            top = 16 - hit[::-1].argmax(axis=0)
            out = np.maximum(out, np.where(hit.any(axis=0), sy * 16 + top, 0))
    return out.astype(np.int32)


def light_of(chunks: dict[int, Sections], blocks: Blocks) -> dict[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """By place and height: (block light, sky light) of each section's cells, spread within the region."""
    lowest, highest = (f((sy for s in chunks.values() for sy in s), default=0) for f in (min, max))
    tall = (highest - lowest + 2) * 16  # a layer of sections of air above
    out: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for bz in range(0, 32, _LIT):
        for bx in range(0, 32, _LIT):
            wide = range(max(0, bx - 1), min(32, bx + _LIT + 1))
            deep = range(max(0, bz - 1), min(32, bz + _LIT + 1))
            if not any(z * 32 + x in chunks for z in range(bz, bz + _LIT) for x in range(bx, bx + _LIT)):
                continue
            shape = (tall, len(deep) * 16, len(wide) * 16)
            cost, glow, top = np.full(shape, 255, np.int16), np.zeros(shape, np.int16), np.zeros(shape[1:], np.int64)
            for z in deep:
                for x in wide:
                    place, at = z * 32 + x, (slice((z - deep[0]) * 16, (z - deep[0]) * 16 + 16), slice((x - wide[0]) * 16, (x - wide[0]) * 16 + 16))
                    if place not in chunks:
                        continue
                    cost[:, *at] = 1
                    for sy, (palette, ids) in chunks[place].items():
                        own = np.array([blocks.of(s)[:2] for s in palette], np.int16)[ids].reshape(16, 16, 16, 2)
                        y = (sy - lowest) * 16
                        cost[y : y + 16, *at] = np.maximum(1, own[..., 0])
                        glow[y : y + 16, *at] = own[..., 1]
                        high = 16 - (own[::-1, :, :, 0] > 0).argmax(axis=0) + y
                        top[at] = np.maximum(top[at], np.where((own[..., 0] > 0).any(axis=0), high, 0))
            sky = np.where((np.arange(tall)[:, None, None] >= top[None]) & (cost < 255), 15, 0)
            lit = [flood(x, cost) for x in (glow, sky)]
            for z in range(bz, bz + _LIT):
                for x in range(bx, bx + _LIT):
                    for sy in chunks.get(z * 32 + x, ()):
                        y, v, u = (sy - lowest) * 16, (z - deep[0]) * 16, (x - wide[0]) * 16
                        out.setdefault(z * 32 + x, {})[sy] = tuple(g[y : y + 16, v : v + 16, u : u + 16].ravel().astype(np.uint8) for g in lit)
    return out


def _nibbles(levels: np.ndarray) -> np.ndarray:
    return levels[0::2] | levels[1::2] << 4


def _predicted_upgrades(palette: list[str], ids: np.ndarray) -> np.ndarray:
    """Places of a section that an upgrade is expected to touch: of upgradeable blocks, not on a side of the chunk."""
    names = [s.partition("[")[0] for s in palette]
    may = np.array([(n.partition(":")[0] if ":" in n else "minecraft") == "minecraft" and n.rpartition(":")[2] in UPGRADEABLE for n in names])
    i = np.arange(4096)
    side = np.isin(i & 15, (0, 15)) | np.isin(i >> 4 & 15, (0, 15))
    return np.flatnonzero(may[ids] & ~side)


def _upgrades(level: dict, sections: Sections, old: str, new: str) -> dict:
    """The level with upgrade indices (``old``: rising numbers by section) replaced by those that the prediction gets wrong (``new``), or back; others stay where they are."""
    data = level.get("UpgradeData", (nbt.COMPOUND, {}))[1]
    if not isinstance(data, dict) or old not in data or data[old][0] != nbt.COMPOUND:
        return level
    out, left = {}, {}
    for key, (kind, indices) in data[old][1].items():
        values = np.asarray(indices) if kind == nbt.INTS else np.zeros(0, int)
        if kind == nbt.INTS and key.removeprefix("-").isdigit() and int(key) in sections and (np.diff(values) > 0).all():
            out[key] = kind, np.setxor1d(values, _predicted_upgrades(*sections[int(key)])).astype(np.int32)
        else:
            left[key] = kind, indices
    own = {k: v for k, v in data.items() if k not in (old, new)}
    own[new] = nbt.COMPOUND, data.get(new, (nbt.COMPOUND, {}))[1] | out
    if left or new == "_WrongIndices":
        own[old] = nbt.COMPOUND, left
    return level | {"UpgradeData": (nbt.COMPOUND, own)}


def is_empty(rest: bytes, version: int | None) -> bool:
    """Whether generation hasn't brought a chunk to its surface, and it holds nothing."""
    from gridloom.operators.filters import STATUS_VERSION, STATUSES

    if version is None or version < STATUS_VERSION:
        return False
    level = nbt.read(rest)[1][1]["Level"][1]
    status = level.get("Status", (nbt.STRING, None))[1]
    if status not in STATUSES or STATUSES.index(status) >= STATUSES.index("surface"):
        return False

    def bare(name: str) -> bool:
        if name not in level:
            return True
        kind, value = level[name]
        return kind == nbt.LIST and (not value[1] or (value[0] == nbt.LIST and not any(v[1] for v in value[1])))

    held = level.get("Structures", (nbt.COMPOUND, {}))
    known = held[0] == nbt.COMPOUND and all(k in ("References", "Starts") and not (v[0] == nbt.COMPOUND and v[1]) for k, v in held[1].items())
    return known and all(bare(k) for k in ("Lights", "LiquidsToBeTicked", "ToBeTicked", "PostProcessing", "Sections", "TileEntities"))


def strip(chunks: dict[int, tuple[bytes, int | None, Sections]], blocks: Blocks, heights: bool, light: bool, upgrades: bool) -> dict[int, tuple[bytes, bytes | None]]:
    """By place: (the document without what can be computed, the differences) of a region's chunks (document, version, sections)."""
    lit = light_of({p: s for p, (_, v, s) in chunks.items() if v is not None}, blocks) if light else {}
    out: dict[int, tuple[bytes, bytes | None]] = {}
    for place, (rest, version, sections) in chunks.items():
        if version is None:
            out[place] = rest, None
            continue
        name, (kind, root) = nbt.read(rest)
        level, off = dict(root["Level"][1]), {}
        if heights:
            try:
                own = {k: h for _, _, k, h in region.height_values(rest)}
            except (ValueError, TypeError, KeyError):
                own = {"": np.zeros(0)}  # of another form: they stay
            if all(h.shape == (256,) for h in own.values()) and nbt.write((nbt.COMPOUND, region.height_tags(own, version))) == nbt.write((nbt.COMPOUND, {k: level[k] for k in ("Heightmaps", "HeightMap") if k in level})):
                for k in ("Heightmaps", "HeightMap"):
                    level.pop(k, None)
                off["heights"] = (nbt.COMPOUND, {k: (nbt.INTS, d if (d := (h - heights_of(sections, k, blocks)).astype(np.int32)).any() else d[:0]) for k, h in own.items()})
        if light:
            away, kept = {}, []
            for section in level.get("Sections", (nbt.LIST, (nbt.COMPOUND, [])))[1][1]:
                sy = region.section_height(section)
                own = dict(section)
                for i, key in enumerate(("BlockLight", "SkyLight")):
                    if key in own and sy in sections and own[key][0] == nbt.BYTES and len(own[key][1]) == 2048:
                        wrong = np.frombuffer(own.pop(key)[1], np.uint8) ^ _nibbles(lit[place][sy][i])
                        away[f"{key}:{sy}"] = (nbt.BYTES, zlib.compress(wrong.tobytes()) if wrong.any() else b"")
                kept.append(own)
            if "Sections" in level:
                level["Sections"] = (nbt.LIST, (nbt.COMPOUND, kept))
            off["light"] = (nbt.COMPOUND, away)
        if upgrades:
            level = _upgrades(level, sections, "Indices", "_WrongIndices")
        out[place] = nbt.write((kind, root | {"Level": (nbt.COMPOUND, level)}), name), zlib.compress(nbt.write((nbt.COMPOUND, off))) if off else None
    return out


def restore(chunks: dict[int, tuple[bytes, int | None, Sections, bytes | None]], blocks: Blocks, upgrades: bool) -> dict[int, bytes]:
    """The documents of strip() (document, version, sections, differences) as they were."""
    offs = {p: nbt.read(zlib.decompress(o))[1][1] for p, (_, _, _, o) in chunks.items() if o}
    lit = light_of({p: s for p, (_, v, s, _) in chunks.items() if v is not None}, blocks) if any("light" in o for o in offs.values()) else {}
    out: dict[int, bytes] = {}
    for place, (rest, version, sections, _) in chunks.items():
        off = offs.get(place, {})
        if version is None or not (off or upgrades):
            out[place] = rest
            continue
        name, (kind, root) = nbt.read(rest)
        level = dict(root["Level"][1])
        if "heights" in off:
            found = {k: heights_of(sections, k, blocks) + (np.asarray(d, np.int32) if len(d) else 0) for k, (_, d) in off["heights"][1].items()}
            level |= region.height_tags(found, version)
        if off.get("light", (0, {}))[1]:
            kept = []
            for section in level["Sections"][1][1]:
                sy = region.section_height(section)
                for i, key in enumerate(("BlockLight", "SkyLight")):
                    if f"{key}:{sy}" in off["light"][1]:
                        wrong = off["light"][1][f"{key}:{sy}"][1]
                        levels = _nibbles(lit[place][sy][i])
                        section = section | {key: (nbt.BYTES, (levels ^ np.frombuffer(zlib.decompress(wrong), np.uint8) if wrong else levels).tobytes())}
                kept.append(section)
            level["Sections"] = (nbt.LIST, (nbt.COMPOUND, kept))
        if upgrades:
            level = _upgrades(level, sections, "_WrongIndices", "Indices")
        out[place] = nbt.write((kind, root | {"Level": (nbt.COMPOUND, level)}), name)
    return out
