"""An ordered symbol codec: contexts of neighbours, self-ordering symbol lists, binarised ranks, arithmetic coding.

Coding is sequential within a region, so a region is one group of an applyInPandas; regions run side by side.  A second codec
codes each section by itself.
"""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_M64 = (1 << 64) - 1
#: The factors and the term of the hash of a context.
HASH_A, HASH_B, HASH_C = 0x65D200CE55B19AD8, 0x4F2162926E40C299, 0x162DD799029970F8
#: Scale of probabilities; (start, limit, delta) of the adaptive bits of each part of a number.
SCALE = 1 << 16
ZERO_BIT, EXPONENT_BIT, MANTISSA_BIT = (0.5, 48, 21), (0.5, 32, 4), (0.5, 16, 4)


def context_slot(low: int, high: int, bits: int) -> int:
    """The slot, of 2 ** bits, of a context of two 64-bit halves."""
    return ((HASH_A * low + HASH_B * high + HASH_C) & _M64) >> (64 - bits)


def context_slot_column(low: Column, high: Column, bits: int) -> Column:
    """context_slot() of columns, in decimals: products of 64-bit numbers would overflow, so they are made in halves of 32 bits."""
    half, two64 = "decimal(10,0)", F.lit(str(1 << 64)).cast("decimal(22,0)")

    def times(x: Column, factor: int) -> Column:
        f0, f1 = (F.lit(v).cast("long").cast(half) for v in (factor & 0xFFFFFFFF, factor >> 32))
        x0, x1 = x.bitwiseAND(0xFFFFFFFF).cast(half), F.shiftrightunsigned(x, 32).cast(half)
        two32 = F.lit(1 << 32).cast("decimal(10,0)")
        cross = ((x0 * f1 + x1 * f0) % two32).cast(half)
        return x0 * f0 + cross * two32

    total = (times(low.cast("long"), HASH_A) + times(high.cast("long"), HASH_B) + F.lit(str(HASH_C)).cast("decimal(20,0)")).cast("decimal(24,0)") % two64
    return F.floor(total / F.lit(str(1 << (64 - bits))).cast("decimal(20,0)")).cast("int")


#: Bounds have 48 bits; 16 leave at a time when they agree.  A range is divided as long as it is at least _LEAST.
_WIDTH = 48
_MASK = (1 << _WIDTH) - 1
_TOP, _LEAST = _WIDTH - 16, 1 << 17


class Encoder:
    """A binary arithmetic coder."""

    def __init__(self):
        self.low, self.high, self.out = 0, _MASK, bytearray()

    def bit(self, value: int, p_zero: int) -> None:
        """Codes a bit whose chance to be 0 is p_zero / SCALE; p_zero lies between 1 and SCALE - 1."""
        middle = self.low + ((self.high - self.low) * p_zero >> 16)
        if value:
            self.low = middle + 1
        else:
            self.high = middle
        while not (self.low ^ self.high) >> _TOP:
            self.out += (self.high >> _TOP).to_bytes(2, "big")
            self.low, self.high = self.low << 16 & _MASK, self.high << 16 & _MASK | 0xFFFF
        while self.high - self.low < _LEAST:  # bounds that are near each other on either side of a step: the part above it is given up
            self.out += (self.low >> _TOP).to_bytes(2, "big")
            self.low, self.high = self.low << 16 & _MASK, _MASK

    def close(self) -> bytes:
        return bytes(self.out) + self.low.to_bytes(_WIDTH // 8, "big")


class Decoder:
    def __init__(self, data: bytes):
        n = _WIDTH // 8
        self.data, self.at = data + bytes(n), n
        self.low, self.high, self.code = 0, _MASK, int.from_bytes(self.data[:n], "big")

    def _more(self) -> None:
        self.code = self.code << 16 & _MASK | int.from_bytes(self.data[self.at : self.at + 2].ljust(2, b"\0"), "big")
        self.at += 2

    def bit(self, p_zero: int) -> int:
        middle = self.low + ((self.high - self.low) * p_zero >> 16)
        value = int(self.code > middle)
        if value:
            self.low = middle + 1
        else:
            self.high = middle
        while not (self.low ^ self.high) >> _TOP:
            self.low, self.high = self.low << 16 & _MASK, self.high << 16 & _MASK | 0xFFFF
            self._more()
        while self.high - self.low < _LEAST:
            self.low, self.high = self.low << 16 & _MASK, _MASK
            self._more()
        return value


@dataclass
class AdaptiveBit:
    """The chance of a 1: each bit moves it by a share of what is missing, 1 / (delta + the bits so far, at most limit)."""

    start: float
    limit: int
    delta: int
    value: float = field(init=False)
    count: int = 0

    def __post_init__(self):
        self.value = self.start * SCALE

    @property
    def p_zero(self) -> int:
        return min(max(SCALE - int(self.value), 1), SCALE - 1)

    def learn(self, bit: int) -> None:
        self.count += self.count < self.limit
        self.value += (bit * SCALE - self.value) / (self.count + self.delta)


class NumberModel:
    """Numbers from 0 to a known maximum: a bit for zero, the exponent in unary, the mantissa bit by bit; what the maximum settles isn't coded."""

    def __init__(self, bits: int = 16):
        self.zero = AdaptiveBit(*ZERO_BIT)
        self.exponent = [AdaptiveBit(*EXPONENT_BIT) for _ in range(bits)]
        self.mantissa = [AdaptiveBit(*MANTISSA_BIT) for _ in range(bits)]

    def _walk(self, most: int, ask) -> int:
        """The number whose bits ``ask(model, bit of a number)`` gives: the same walk codes and decodes."""
        if most == 0 or ask(self.zero, lambda n: n == 0):
            return 0
        top, e = most.bit_length() - 1, 0
        while e < top and not ask(self.exponent[e], lambda n, e=e: n.bit_length() - 1 == e):
            e += 1
        n = 1 << e
        for i in reversed(range(e)):
            if n | 1 << i <= most and ask(self.mantissa[i], lambda x, i=i: x >> i & 1):
                n |= 1 << i
        return n

    def encode(self, coder: Encoder, n: int, most: int) -> None:
        def put(model: AdaptiveBit, bit_of) -> bool:
            bit = int(bit_of(n))
            coder.bit(bit, model.p_zero)
            model.learn(bit)
            return bool(bit)

        self._walk(most, put)

    def decode(self, coder: Decoder, most: int) -> int:
        def get(model: AdaptiveBit, _) -> bool:
            bit = coder.bit(model.p_zero)
            model.learn(bit)
            return bool(bit)

        return self._walk(most, get)


class RankedSymbols:
    """Symbols by how often they came in a context.

    A symbol that comes moves up past those that don't have more hits than it has with a bonus: 1, and 1 more for each 32 hits of the context.
    """

    def __init__(self, size: int):
        self.order, self.hits, self.total = list(range(size)), [0] * size, 0
        self.model = NumberModel()

    def rank(self, symbol: int) -> int:
        return self.order.index(symbol)

    def hit(self, rank: int) -> None:
        symbol = self.order[rank]
        self.hits[symbol] += 1
        self.total += 1
        reach, to = self.hits[symbol] + 1 + self.total // 32, rank
        while to and self.hits[self.order[to - 1]] <= reach:
            to -= 1
        self.order.insert(to, self.order.pop(rank))


class GridCodec:
    """Ids of a dense grid, x fastest, then z, then y, each in the context of cells coded before it."""

    NEIGHBOURS = ((-1, 0, 0), (0, -1, 0), (0, 0, -1))

    def __init__(self, palette: int, context_bits: int = 12, neighbours=NEIGHBOURS):
        if not 1 <= context_bits <= 16 or len(neighbours) > 4:
            raise ValueError("1 to 16 context bits and at most four neighbours")
        self.palette, self.bits, self.neighbours = palette, context_bits, tuple(neighbours)
        self.slots: dict[int, RankedSymbols] = {}

    @property
    def rim(self) -> int:
        """How far neighbours reach, 1 at least."""
        return max([1, *(abs(v) for o in self.neighbours for v in o)])

    def _flat(self, shape: tuple[int, ...], mask: np.ndarray | None) -> tuple[int, np.ndarray, list[tuple[int, int]]]:
        """(cells of the grid with a rim that neighbours may lie in, the places of those that are coded, the way to each neighbour and its shift in a key)."""
        rim = self.rim
        wide = [n + 2 * rim for n in shape]
        own = np.argwhere(np.ones(shape, bool) if mask is None else mask) + rim
        ways = [((dy * wide[1] + dz) * wide[2] + dx, 16 * i) for i, (dx, dy, dz) in enumerate(self.neighbours)]
        return int(np.prod(wide)), np.ravel_multi_index(own.T, wide), ways

    def _own(self, key: int, found: dict[int, RankedSymbols]) -> RankedSymbols:
        """The context of a key; keys that share a slot share it."""
        slot = context_slot(key & 0xFFFFFFFF, key >> 32, self.bits)
        if slot not in self.slots:
            self.slots[slot] = RankedSymbols(self.palette)
        found[key] = self.slots[slot]
        return found[key]

    def encode(self, grid: np.ndarray, mask: np.ndarray | None = None) -> bytes:
        """The ids of a grid (y, z, x), of the cells of the mask only if there is one; others count as 0."""
        size, places, ways = self._flat(grid.shape, mask)
        cells, coder, found, most = array("i", bytes(4 * size)), Encoder(), {}, self.palette - 1
        ids = grid.ravel() if mask is None else grid[mask]
        for at, symbol in zip(places.tolist(), ids.tolist(), strict=True):
            key = 0
            for d, shift in ways:
                key |= cells[at + d] << shift
            own = found.get(key) or self._own(key, found)
            rank = own.rank(symbol)
            own.model.encode(coder, rank, most)
            own.hit(rank)
            cells[at] = symbol
        return coder.close()

    def decode(self, data: bytes, shape: tuple[int, int, int], mask: np.ndarray | None = None) -> np.ndarray:
        size, places, ways = self._flat(shape, mask)
        cells, coder, found, most = array("i", bytes(4 * size)), Decoder(data), {}, self.palette - 1
        for at in places.tolist():
            key = 0
            for d, shift in ways:
                key |= cells[at + d] << shift
            own = found.get(key) or self._own(key, found)
            rank = own.model.decode(coder, most)
            cells[at] = own.order[rank]
            own.hit(rank)
        out = np.zeros(shape, np.int64)
        out[np.ones(shape, bool) if mask is None else mask] = np.frombuffer(cells, np.int32)[places]
        return out


_NEIGHBOURS, _PLACES = "array<struct<dx:int,dy:int,dz:int>>", "array<struct<cx:long,cy:long,cz:long>>"


def _closed(sections: np.ndarray, rim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For y, z and x: the coordinates of sections (cy, cz, cx), and where they stand once gaps are only as wide as neighbours reach.

    Sections that aren't there aren't coded and count as 0, so the code stays the same, however far apart sections lie.
    """
    out = []
    for own in sections.T:
        old = np.unique(own)
        out.append((old, old[0] + np.r_[0, np.cumsum(np.minimum(np.diff(old), 1 - -rim // 16))]))
    return out


def _moved(at: np.ndarray, axes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sections (cy, cz, cx) of the first coordinates of each axis in the second ones."""
    return np.stack([new[np.searchsorted(old, a)] for a, (old, new) in zip(at.T, axes, strict=True)], axis=1)


def _mask(shape, least, sections) -> np.ndarray:
    """The cells of a grid that lie in some sections (cy, cz, cx)."""
    out = np.zeros(shape, bool)
    for low in sections * 16 - least:
        out[tuple(slice(max(0, int(a)), max(0, int(a) + 16)) for a in low)] = True
    return out


def sections_of(cells: DataFrame, region: str, symbol: str) -> DataFrame:
    """(region, cx, cy, cz, at, ids): the cells (x, y, z, id) of each cube of 16 as two arrays, so that a region is some thousand rows, not millions."""
    cube = [F.floor(F.col(k) / 16).cast("long").alias(f"c{k}") for k in "xyz"]
    index = F.pmod("y", F.lit(16)) * 256 + F.pmod("z", F.lit(16)) * 16 + F.pmod("x", F.lit(16))
    own = cells.select(region, *cube, F.struct(index.cast("short").alias("at"), F.col(symbol).cast("int").alias("id")).alias("cell"))
    held = own.groupBy(region, "cx", "cy", "cz").agg(F.collect_list("cell").alias("cells"))  # at most 4,096
    return held.select(region, "cx", "cy", "cz", "cells.at", F.col("cells.id").alias("ids"))


def encode_regions(cells: DataFrame, region: str, symbol: str = "sym_id", context_bits: int = 12, neighbours=GridCodec.NEIGHBOURS) -> DataFrame:
    """(region, nx, ny, nz, x0, y0, z0, sections, palette, context_bits, neighbours, payload): the cells of each region (x, y, z, id), coded.

    Sections without cells aren't coded and take no memory where layers of them lie between others; in others what isn't there is 0.  Coding is sequential, so a region is one task; it
    is handed over as arrays of sections (``sections_of``).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        many = pdf["ids"].map(len).to_numpy()
        at = np.concatenate(pdf["at"].to_list()).astype(np.int64)
        held = pdf[["cy", "cz", "cx"]].to_numpy(np.int64)
        axes = _closed(held, GridCodec(1, context_bits, neighbours).rim)
        near = _moved(held, axes)
        place = np.repeat(near * 16, many, axis=0) + np.stack([at >> 8, at >> 4 & 15, at & 15], axis=1)
        ids = np.concatenate(pdf["ids"].to_list())
        least = place.min(axis=0)  # of the first sections, which stay
        most = place.max(axis=0)
        grid = np.zeros(most - least + 1, np.int32)
        grid[tuple((place - least).T)] = ids
        palette = int(grid.max()) + 1
        shape = most - least + 1 + [(old[-1] - new[-1]) * 16 for old, new in axes]
        sections = pdf[["cx", "cy", "cz"]].to_dict("records")
        payload = GridCodec(palette, context_bits, neighbours).encode(grid, _mask(grid.shape, least, near))
        return pd.DataFrame({region: [pdf[region].iloc[0]], "nx": [shape[2]], "ny": [shape[0]], "nz": [shape[1]], "x0": [least[2]], "y0": [least[0]], "z0": [least[1]], "sections": [sections], "palette": [palette], "context_bits": [context_bits], "neighbours": [[dict(zip(("dx", "dy", "dz"), o, strict=True)) for o in neighbours]], "payload": [payload]})

    kind = dict(cells.dtypes)[region]
    return sections_of(cells, region, symbol).groupBy(region).applyInPandas(run, f"{region} {kind}, nx long, ny long, nz long, x0 long, y0 long, z0 long, sections {_PLACES}, palette int, context_bits int, neighbours {_NEIGHBOURS}, payload binary")


def decode_regions(coded: DataFrame, region: str, symbol: str = "sym_id") -> DataFrame:
    """(region, x, y, z, id) of the cells of encode_regions()'s sections, a layer at a time."""
    kind = dict(coded.dtypes)[region]

    def run(parts):
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                own = GridCodec(r.palette, r.context_bits, [(o["dx"], o["dy"], o["dz"]) for o in r.neighbours])
                sections = np.array([(s["cy"], s["cz"], s["cx"]) for s in r.sections], np.int64)
                axes, least = _closed(sections, own.rim), np.array([r.y0, r.z0, r.x0])
                shape = np.array([r.ny, r.nz, r.nx]) - [(old[-1] - new[-1]) * 16 for old, new in axes]
                mask = _mask(shape, least, _moved(sections, axes))
                grid = own.decode(bytes(r.payload), mask.shape, mask)
                back = [(new, old) for old, new in axes]
                for y, (layer, held) in enumerate(zip(grid, mask, strict=True)):
                    if held.any():
                        z, x = np.nonzero(held)
                        at = np.stack([np.full(len(z), y), z, x], axis=1) + least
                        ys, zs, xs = (_moved(at >> 4, back) * 16 + (at & 15)).T
                        yield pd.DataFrame({region: getattr(r, region), "x": xs, "y": ys, "z": zs, symbol: layer[held]}, columns=[region, "x", "y", "z", symbol])

    return coded.mapInPandas(run, f"{region} {kind}, x long, y long, z long, {symbol} int")


# -- section-major: the ids of each section as one compressed string --


def encode_sections(cells: DataFrame, region: str, symbol: str = "sym_id", level: int = 6) -> DataFrame:
    """(region, cx, cy, cz, payload): the cells of each cube of 16 by themselves, ids as varints behind a bitmap of the cells that are there, compressed.

    Sections don't depend on each other, so they are coded side by side and can be read alone.
    """

    @F.pandas_udf("binary")
    def coded(at: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([_section_bytes(np.asarray(a, np.int64), np.asarray(i, np.uint32), level) for a, i in zip(at, ids, strict=True)])

    return sections_of(cells, region, symbol).select(region, "cx", "cy", "cz", coded("at", "ids").alias("payload"))


def _section_bytes(at: np.ndarray, ids: np.ndarray, level: int) -> bytes:
    held = np.zeros(4096, np.uint8)
    held[at] = 1
    ids = ids[np.argsort(at)]
    width = 1 + sum((ids >= 1 << 7 * k).astype(np.int64) for k in range(1, 5)) if len(ids) else np.zeros(0, np.int64)
    place = np.repeat(np.arange(len(ids)), width)
    k = np.arange(len(place)) - np.repeat(np.cumsum(width) - width, width)
    out = (ids[place] >> (7 * k).astype(np.uint32) & 127 | np.where(k + 1 < width[place], 128, 0)).astype(np.uint8)
    return zlib.compress(np.packbits(held).tobytes() + out.tobytes(), level)


def decode_sections(coded: DataFrame, region: str, symbol: str = "sym_id") -> DataFrame:
    """(region, x, y, z, id) of encode_sections()."""

    @F.pandas_udf("array<struct<at:short,id:int>>")
    def cells(payload: pd.Series) -> pd.Series:
        out = []
        for data in payload:
            raw = np.frombuffer(zlib.decompress(data), np.uint8)
            at = np.flatnonzero(np.unpackbits(raw[:512]))
            body = raw[512:]
            last = np.flatnonzero(body < 128)
            first = np.r_[0, last[:-1] + 1].astype(np.int64)
            k = np.arange(len(body)) - np.repeat(first, last - first + 1)
            ids = np.add.reduceat((body & 127).astype(np.int64) << 7 * k, first) if len(last) else first[:0]
            out.append([{"at": a, "id": i} for a, i in zip(at.tolist(), ids.tolist(), strict=True)])
        return pd.Series(out)

    c = coded.select(region, "cx", "cy", "cz", F.explode(cells("payload")).alias("c"))
    at = F.col("c.at").cast("int")
    return c.select(region, (F.col("cx") * 16 + at.bitwiseAND(15)).alias("x"), (F.col("cy") * 16 + F.shiftright(at, 8)).alias("y"), (F.col("cz") * 16 + F.shiftright(at, 4).bitwiseAND(15)).alias("z"), F.col("c.id").alias(symbol))
