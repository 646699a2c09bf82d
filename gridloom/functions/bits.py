"""Integer and bit functions: Column to Column; binary codecs as Arrow-batched UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def zigzag(v: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3."""
    v = v.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(u: Column) -> Column:
    u = u.cast("long")
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-(u.bitwiseAND(1)))


def bit_length(v: Column) -> Column:
    """Bits of a non-negative number; 0 has one."""
    return F.length(F.bin(v.cast("long")))


def varint_size(v: Column) -> Column:
    """Bytes of a little-endian base-128 number."""
    return (1 + F.floor((bit_length(v) - 1) / 7)).cast("int")


def floor_log2(v: Column) -> Column:
    return bit_length(v) - 1


def ceil_log2(v: Column) -> Column:
    """0 for 0 and 1."""
    return F.when(v <= 1, 0).otherwise(bit_length(v - 1))


def is_pow2(v: Column) -> Column:
    return (v > 0) & (v.bitwiseAND(v - 1) == 0)


def round_up_pow2(v: Column) -> Column:
    return F.pow(F.lit(2), ceil_log2(v)).cast("long")


def range_mask(low: Column, high: Column) -> Column:
    """Bits ``low`` to ``high`` - 1 set."""
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, high.cast("int")) - F.call_function("shiftleft", one, low.cast("int"))


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("long")


def floor_div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("long")


def palette_bits(size: Column, least: int = 4) -> Column:
    """Bits of an index into a palette, ``least`` at least."""
    return F.greatest(F.lit(least), ceil_log2(size.cast("long"))).cast("int")


def nibble(data: Column, index: Column) -> Column:
    """The 4-bit value ``index`` of a binary column, low half first."""
    byte = F.conv(F.hex(F.substring(data, F.floor(index / 2).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.when(index % 2 == 0, byte.bitwiseAND(15)).otherwise(F.shiftright(byte, 4))


def nibble_pack(low: Column, high: Column) -> Column:
    return low.bitwiseAND(15).bitwiseOR(F.shiftleft(high.bitwiseAND(15), 4))


def sparse_get(words: Column, index: Column, bits: int) -> Column:
    """Value ``index`` of 64-bit words that hold 64 // ``bits`` values each, none across words."""
    per = 64 // bits
    word = F.element_at(words, F.floor(index / per).cast("int") + 1)
    return F.call_function("shiftrightunsigned", word, ((index % per) * bits).cast("int")).bitwiseAND(F.lit((1 << bits) - 1))


def sparse_unpack(words: Column, bits: int, count: Column) -> Column:
    """All ``count`` values of such words."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: sparse_get(words, i, bits))


def byte_swap(v: Column, size: int) -> Column:
    """The number with its ``size`` bytes reversed."""
    digits = F.lpad(F.right(F.hex(v.cast("long")), F.lit(2 * size)), 2 * size, "0")
    swapped = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))))
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


# -- numpy kernels, and the UDFs over them --


def varints(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as base-128, low groups first."""
    v = np.asarray(values).astype(np.uint64)
    groups = np.stack([(v >> np.uint64(7 * i)) & np.uint64(127) for i in range(10)], axis=1).astype(np.uint8)
    many = np.maximum(1, 10 - np.argmax(groups[:, ::-1] > 0, axis=1))
    many[~groups.any(axis=1)] = 1
    at = np.arange(10)[None, :]
    groups |= np.where(at < many[:, None] - 1, 128, 0).astype(np.uint8)
    return groups[at < many[:, None]].tobytes()


def unvarints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(b < 128)
    if not len(last) or last[-1] != len(b) - 1:
        raise ValueError("the last number is cut off")
    starts = np.r_[0, last[:-1] + 1]
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.r_[starts, len(b)]))
    if place.max() > 9:
        raise ValueError("a number is too long")
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def pack_bits(values: np.ndarray, bits: int, spanning: bool) -> np.ndarray:
    """Numbers of ``bits`` bits in 64-bit words, low bits first; across words if ``spanning``."""
    v = np.asarray(values, np.uint64)
    if spanning:
        flat = (v[:, None] >> np.arange(bits, dtype=np.uint64)[None, :] & np.uint64(1)).astype(np.uint8).ravel()
    else:
        per = 64 // bits
        v = np.r_[v, np.zeros(-len(v) % per, np.uint64)]
        rows = (v[:, None] >> np.arange(bits, dtype=np.uint64)[None, :] & np.uint64(1)).astype(np.uint8).reshape(-1, per * bits)
        flat = np.pad(rows, ((0, 0), (0, 64 - per * bits))).ravel()
    return np.packbits(np.r_[flat, np.zeros(-len(flat) % 64, np.uint8)], bitorder="little").view(np.uint64)


def unpack_bits(words: np.ndarray, bits: int, count: int, spanning: bool) -> np.ndarray:
    flat = np.unpackbits(np.ascontiguousarray(words, np.uint64).view(np.uint8), bitorder="little")
    if not spanning:
        flat = flat.reshape(-1, 64)[:, : 64 // bits * bits].ravel()
    flat = flat[: count * bits].reshape(count, bits).astype(np.uint64)
    return (flat << np.arange(bits, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)


class BitWriter:
    """Numbers of any width, low bits first; whole bytes leave at once, so time grows with the number of bits."""

    def __init__(self):
        self.out, self.held, self.width = bytearray(), 0, 0

    def put(self, value: int, width: int) -> None:
        self.held |= (value & (1 << width) - 1) << self.width
        self.width += width
        if whole := self.width // 8:
            self.out += (self.held & (1 << 8 * whole) - 1).to_bytes(whole, "little")
            self.held >>= 8 * whole
            self.width -= 8 * whole

    def close(self) -> bytes:
        return bytes(self.out) + (self.held.to_bytes(1, "little") if self.width else b"")


class BitReader:
    """The inverse of BitWriter."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def get(self, width: int) -> int:
        first, last = self.at // 8, -(-(self.at + width) // 8)
        out = int.from_bytes(self.data[first:last], "little") >> self.at % 8 & (1 << width) - 1
        self.at += width
        return out


@F.pandas_udf(T.BinaryType())
def bits_write(values: pd.Series, widths: pd.Series) -> pd.Series:
    """An array of numbers, each in its own width (an array as long), as a string of bits."""

    def one(v, w):
        out = BitWriter()
        for x, k in zip(v, w, strict=True):
            out.put(int(x), int(k))
        return out.close()

    return pd.Series([None if v is None else one(v, w) for v, w in zip(values, widths, strict=True)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def bits_read(data: pd.Series, widths: pd.Series) -> pd.Series:
    """The inverse of bits_write()."""

    def one(d, w):
        own = BitReader(bytes(d))
        return [own.get(int(k)) for k in w]

    return pd.Series([None if d is None else one(d, w) for d, w in zip(data, widths, strict=True)])


@F.pandas_udf(T.BinaryType())
def varint_encode(values: pd.Series) -> pd.Series:
    """An array of numbers as varints; all arrays of a batch are coded together."""
    many = values.map(lambda v: 0 if v is None else len(v)).to_numpy(np.int64)
    held = [np.asarray(v, np.int64) for v in values if v is not None and len(v)]
    flat = np.concatenate(held) if held else np.zeros(0, np.int64)
    data = varints(flat.view(np.uint64))
    ends = np.r_[0, np.flatnonzero(np.frombuffer(data, np.uint8) < 128) + 1][np.cumsum(many)].tolist()
    return pd.Series([None if v is None else data[a:b] for v, a, b in zip(values, [0, *ends], ends, strict=False)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def varint_decode(data: pd.Series) -> pd.Series:
    """The inverse of varint_encode(); a number that is cut off or too long fails."""
    held = [b"" if v is None else bytes(v) for v in data]
    if any(v and v[-1] & 128 for v in held):
        raise ValueError("the last number is cut off")
    whole = b"".join(held)
    flat, last = unvarints(whole).view(np.int64), np.flatnonzero(np.frombuffer(whole, np.uint8) < 128)
    cuts = np.searchsorted(last, np.cumsum([0, *map(len, held)])).tolist()
    return pd.Series([None if v is None else flat[a:b] for v, a, b in zip(data, cuts, cuts[1:], strict=False)])


# -- typed memory: numbers at places of a binary column --

#: Bytes of each type of number, and whether it has a sign.
NUMBERS = {"u8": (1, False), "i8": (1, True), "u16": (2, False), "i16": (2, True), "u32": (4, False), "i32": (4, True), "u64": (8, False), "i64": (8, True)}


def read_number(data: Column, offset: Column, kind: str, little: bool = False) -> Column:
    """A number of a type of ``NUMBERS`` at a byte offset; null beyond the end.  u64 is a decimal."""
    size, signed = NUMBERS[kind]
    raw = F.substring(data, offset.cast("int") + 1, F.lit(size))
    digits = F.hex(raw)
    if little:
        digits = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))))
    value = F.conv(digits, 16, 10).cast("decimal(20,0)")
    if signed:
        value = F.when(value >= F.lit(1 << 8 * size - 1).cast("decimal(20,0)"), value - F.lit(str(1 << 8 * size)).cast("decimal(21,0)")).otherwise(value)
    return F.when((offset >= 0) & (F.octet_length(raw) == size), value.cast("decimal(20,0)" if kind == "u64" else "long"))


def number_bytes(value: Column, kind: str, little: bool = False) -> Column:
    """The inverse of read_number(): the value's bytes (two's complement)."""
    size, _ = NUMBERS[kind]
    digits = F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * size))
    if little:
        digits = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))))
    return F.unhex(digits)


def read_text(data: Column, offset: Column, little: bool = False) -> Column:
    """A string behind its length in two bytes."""
    return F.substring(data, offset.cast("int") + 3, read_number(data, offset, "u16", little).cast("int")).cast("string")


def text_bytes(text: Column, little: bool = False) -> Column:
    return F.concat(number_bytes(F.octet_length(text), "u16", little), text.cast("binary"))


# -- sets of small numbers as arrays of 64-bit words --


def bitset(values: Column, size: int) -> Column:
    """The set of an array of numbers below ``size``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit((size - 1) // 64)),
        lambda w: F.aggregate(F.filter(F.array_distinct(values), lambda v: F.floor(v / 64) == w), F.lit(0).cast("long"), lambda a, v: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (v % 64).cast("int")))),
    )


def bitset_has(words: Column, index: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.element_at(words, (F.floor(index / 64) + 1).cast("int")), (index % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def bitset_count(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.bit_count(w))


def bitset_next(words: Column, start: Column) -> Column:
    """The smallest member at or above ``start``; -1 if there is none."""
    def members(w, i):
        return F.filter(F.sequence(i * 64, i * 64 + 63), lambda v: F.call_function("shiftrightunsigned", w, (v % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)

    every = F.flatten(F.transform(words, lambda w, i: F.when(w == 0, F.array().cast("array<int>")).otherwise(members(w, i))))
    return F.coalesce(F.array_min(F.filter(every, lambda v: v >= start)), F.lit(-1))


def bitset_all(words: Column, size: int) -> Column:
    """Whether every number below ``size`` is a member."""
    return bitset_count(words) == size


def visit(values: Column, of, kind: str = "long") -> Column:
    """An array with ``of(value, index)`` applied to each element, as numbers of ``kind``."""
    return F.transform(values, lambda v, i: of(v, i).cast(kind))


def bit_unpack(words: Column, bits: Column, count: Column, spanning: bool) -> Column:
    """An array of 64-bit words as numbers, for widths that differ by row."""

    @F.pandas_udf("array<long>")
    def run(w: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else unpack_bits(np.asarray(x, np.int64).view(np.uint64), int(k), int(m), spanning).astype(np.int64) for x, k, m in zip(w, b, n, strict=True)])

    return run(words, bits, count)


def bit_pack(values: Column, bits: Column, spanning: bool) -> Column:
    @F.pandas_udf("array<long>")
    def run(v: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else pack_bits(np.asarray(x), int(k), spanning).view(np.int64) for x, k in zip(v, b, strict=True)])

    return run(values, bits)
