"""Transforms of grids as DataFrame functions, piped, reversed, and chosen by settings."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.names import resource_path, state_name
from gridloom.operators.filters import is_opaque
from gridloom.operators.hidden import neighbour_sample, replace_hidden, running_replacements
from gridloom.operators.merge import symmetric_difference
from gridloom.operators.neighbours import SIX
from gridloom.operators.palette import palette_by_frequency, remap
from gridloom.plans.settings import build, parse_list
from gridloom.sources.region import AIRS


@dataclass(frozen=True)
class Transform:
    """cells -> cells; a reversible one has an inverse."""

    def apply(self, cells: DataFrame) -> DataFrame:
        raise NotImplementedError

    reversible = False

    def reverse(self, cells: DataFrame) -> DataFrame:
        raise NotImplementedError


#: Blocks that may be replaced where they can't be seen: paths of names, numbers of old versions.
HIDEABLE = tuple(
    """
    granite polished_granite diorite polished_diorite andesite polished_andesite bedrock gravel gold_ore iron_ore coal_ore nether_gold_ore
    redstone_ore lapis_ore diamond_ore emerald_ore nether_quartz_ore stone dirt sand sandstone
    """.split()
)
HIDEABLE_NUMBERS = (1, 3, 12, 24, 73, 74)
#: Blocks that one can see through, where cells have no flags: what has no attributes counts as opaque otherwise.
CLEAR = (*AIRS, "water", "lava", "glass", "ice", 0, 8, 9, 10, 11, 20, 79)


def _is_one_of(block: Column, names) -> Column:
    """Blocks of these names (states count by their name, with or without a namespace) or numbers."""
    numbers, names = ([str(n) for n in names if str(n).isdigit() is k] for k in (True, False))
    name, old = state_name(block), block.rlike(r"^\d+:\d+$")
    by_name = name.isin(names) | resource_path(name).isin([n for n in names if ":" not in n])
    return F.when(old, F.split_part(block, F.lit(":"), F.lit(1)).isin(numbers)).otherwise(by_name)


@dataclass(frozen=True)
class RemoveHidden(Transform):
    """Blocks that nothing transparent touches become what is frequent around them: the six that touch and ``samples`` of those within ``radius``.

    With ``cum_freqs`` counts go on from cell to cell of a region, in order; without, each cell by itself, by what stood there before.
    Cells with ``flags`` are opaque by them (``filters.is_opaque``), others unless ``transparent`` names their block.  ``whitelist``
    names what may be replaced; none: everything.
    """

    samples: int = 8
    radius: int = 2
    cum_freqs: bool = True
    whitelist: tuple | list | None = (*HIDEABLE, *HIDEABLE_NUMBERS)
    transparent: tuple | list = CLEAR

    def apply(self, cells: DataFrame) -> DataFrame:
        offsets = neighbour_sample(self.radius, self.samples) if self.samples else []
        clear = ~is_opaque(F.col("flags")) if "flags" in cells.columns else _is_one_of(F.col("block"), self.transparent)
        may = F.lit(True) if self.whitelist is None else _is_one_of(F.col("block"), self.whitelist)
        if not self.cum_freqs:
            return replace_hidden(cells, clear, may, [*SIX, *offsets])
        # chunks of old numbers can't hold names, nor the other way round
        region = F.concat_ws("/", *(["path"] if "path" in cells.columns else []), F.floor(F.col("x") / 512), F.floor(F.col("z") / 512), F.col("block").rlike(r"^\d+:\d+$"))
        return running_replacements(cells.withColumns({"_region": region, "_clear": clear, "_may": may}), "_region", offsets).drop("_region", "_clear", "_may")


@dataclass(frozen=True)
class RemoveEmptyChunks(Transform):
    """Chunks that hold nothing go (plans.world); cells stay as they are."""

    def apply(self, cells: DataFrame) -> DataFrame:
        return cells


@dataclass(frozen=True)
class SimplifyUpgradeData(Transform):
    """Of a chunk's upgrade indices only those stay that can't be told from its cells (plans.world); cells stay as they are."""

    reversible = True

    def apply(self, cells: DataFrame) -> DataFrame:
        return cells

    def reverse(self, cells: DataFrame) -> DataFrame:
        return cells


@dataclass(frozen=True)
class SortPalette(Transform):
    """Adds ids by frequency."""

    def apply(self, cells: DataFrame) -> DataFrame:
        return remap(cells, palette_by_frequency(cells))

    reversible = True

    def reverse(self, cells: DataFrame) -> DataFrame:
        return cells.drop("sym_id")


@dataclass(frozen=True)
class Rename(Transform):
    """Renames one block; reversible, as the new name must not occur before."""

    old: str = ""
    new: str = ""
    reversible = True

    def _swap(self, cells: DataFrame, a: str, b: str) -> DataFrame:
        return cells.withColumn("block", F.when(F.col("block") == a, b).otherwise(F.col("block")))

    def apply(self, cells: DataFrame) -> DataFrame:
        return self._swap(cells, self.old, self.new)

    def reverse(self, cells: DataFrame) -> DataFrame:
        return self._swap(cells, self.new, self.old)


@dataclass(frozen=True)
class PredictIndices(Transform):
    """Keeps only the (section, index) pairs that a prediction gets wrong; the same step brings them back."""

    predicted: DataFrame | None = None
    keys: tuple[str, ...] = ("section", "index")
    reversible = True

    def apply(self, cells: DataFrame) -> DataFrame:
        return symmetric_difference(cells, self.predicted, list(self.keys)).drop("only_right")

    def reverse(self, cells: DataFrame) -> DataFrame:
        return self.apply(cells)


REGISTRY = {"remove_hidden_blocks": RemoveHidden, "remove_empty_chunks": RemoveEmptyChunks, "simplify_upgrade_data": SimplifyUpgradeData, "sort_palette": SortPalette, "rename": Rename, "predict_indices": PredictIndices}


class Pipe:
    """Transforms in a row."""

    def __init__(self, *steps: Transform):
        self.steps = steps

    @classmethod
    def parse(cls, text: str) -> Pipe:
        return cls(*(build(REGISTRY, s) for s in parse_list(text)))

    def has(self, kind: type[Transform]) -> bool:
        return any(isinstance(t, kind) for t in self.steps)

    def of_cells(self) -> Pipe:
        """The steps that change cells; numbering is the container's own."""
        return Pipe(*(t for t in self.steps if not isinstance(t, (RemoveEmptyChunks, SimplifyUpgradeData, SortPalette))))

    def __add__(self, other: Pipe) -> Pipe:
        return Pipe(*self.steps, *other.steps)

    def apply(self, cells: DataFrame) -> DataFrame:
        return reduce(lambda df, t: df.transform(t.apply), self.steps, cells)

    def reverse(self, cells: DataFrame) -> DataFrame:
        """Undoes the reversible transforms, last first."""
        return reduce(lambda df, t: df.transform(t.reverse), [t for t in reversed(self.steps) if t.reversible], cells)


_CHUNKS = "remove_empty_chunks,simplify_upgrade_data"


@dataclass(frozen=True)
class Preset:
    """How to store a grid: the codec of cells (ordered, sections, columns), its settings, what to do with heights and light (keep, strip, auto), and the transforms."""

    codec: str = "ordered"
    context_bits: int = 13
    neighbours: tuple[tuple[int, int, int], ...] = ((-1, 0, 0), (0, -1, 0), (0, 0, -1))
    level: int = 6
    heights: str = "keep"
    light: str = "keep"
    transforms: str = _CHUNKS

    def with_values(self, **values) -> Preset:
        return replace(self, **{k: v for k, v in values.items() if v is not None})


#: Presets by name.
PRESETS = {
    "fast": Preset(codec="sections", level=5),
    "default": Preset(),
    "smaller": Preset(light="auto", heights="strip"),
    "lossy": Preset(light="strip", heights="strip", transforms=f"{_CHUNKS},remove_hidden_blocks"),
}


def keep_or_strip(mode: str, all_known: bool) -> str:
    """auto strips derived columns only if they can all be computed again."""
    return ("strip" if all_known else "keep") if mode == "auto" else mode
