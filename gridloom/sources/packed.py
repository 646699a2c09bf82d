"""Documents of tags packed together: shapes, repeated strings and narrow numbers are learned from them first.

A batch of documents shares one dictionary: the shapes of its compounds (names and types of their fields), the strings that
occur more than once (256 at most), and for each whole-number field of a shape the narrowest storage of its range.  A field that
never changes is stored once.  Documents come back exactly.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gridloom.functions.bits import unvarints, varints
from gridloom.sources import nbt

#: How many strings are numbered; the version of the form.
STRINGS, VERSION = 256, 1
_WHOLE = (nbt.BYTE, nbt.SHORT, nbt.INT, nbt.LONG)
_FORMS = ("const", "u8", "s8", "u16", "s16", "var")
_STRUCT = {"u8": "<B", "s8": "<b", "u16": "<H", "s16": "<h"}
_RANGE = {"u8": (0, 255), "s8": (-128, 127), "u16": (0, 65535), "s16": (-32768, 32767)}


def _width(least: int, most: int) -> str:
    if least == most:
        return "const"
    return next((k for k, (a, b) in _RANGE.items() if a <= least and most <= b), "var")


class _Writer:
    def __init__(self):
        self.out = bytearray()

    def number(self, n: int) -> None:
        self.out += varints([n])

    def signed(self, n: int) -> None:
        self.number((n << 1 ^ n >> 63) & (1 << 64) - 1)

    def text(self, s: str) -> None:
        raw = s.encode("utf-8", "surrogatepass")
        self.number(len(raw))
        self.out += raw


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise nbt.BadTag("the data ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        end = self.at
        while end < len(self.data) and self.data[end] & 128:
            end += 1
        return int(unvarints(self.take(end + 1 - self.at))[0])

    def signed(self) -> int:
        n = self.number()
        return n >> 1 ^ -(n & 1)

    def text(self) -> str:
        return self.take(self.number()).decode("utf-8", "surrogatepass")


def _shape(value: dict) -> tuple:
    return tuple((name, tag[0]) for name, tag in value.items())


def pack(documents: list[tuple[str, nbt.Tag]]) -> bytes:
    """Documents (name, tag) as one string of bytes."""
    shapes: dict[tuple, int] = {}
    ranges: dict[tuple[int, int], list[int]] = {}
    strings: Counter[str] = Counter()

    def learn(kind: int, value) -> None:
        if kind == nbt.STRING:
            strings[value] += 1
        elif kind == nbt.LIST:
            for v in value[1]:
                learn(value[0], v)
        elif kind == nbt.COMPOUND:
            shape = shapes.setdefault(_shape(value), len(shapes))
            for i, (own, v) in enumerate(value.values()):
                if own in _WHOLE:
                    held = ranges.setdefault((shape, i), [int(v), int(v)])
                    held[:] = min(held[0], int(v)), max(held[1], int(v))
                learn(own, v)

    for name, (kind, value) in documents:
        strings[name] += 1
        learn(kind, value)
    pool = {s: i + 1 for i, (s, _) in enumerate(sorted(((s, n) for s, n in strings.items() if n > 1), key=lambda x: (-x[1], x[0]))[:STRINGS])}
    forms = {k: _width(*r) for k, r in ranges.items()}
    w = _Writer()
    w.number(VERSION)
    w.number(len(pool))
    for s in pool:
        w.text(s)
    w.number(len(shapes))
    for shape, i in shapes.items():
        w.number(len(shape))
        for j, (name, kind) in enumerate(shape):
            w.text(name)
            w.out.append(kind)
            if kind in _WHOLE:
                w.out.append(_FORMS.index(forms[i, j]))
                if forms[i, j] == "const":
                    w.signed(ranges[i, j][0])

    def text(s: str) -> None:
        w.number(pool.get(s, 0))
        if s not in pool:
            w.text(s)

    def put(kind: int, value, form: str = "var") -> None:
        if kind in _WHOLE:
            if form == "var":
                w.signed(int(value))
            elif form != "const":
                w.out += struct.pack(_STRUCT[form], int(value))
        elif kind in (nbt.FLOAT, nbt.DOUBLE):
            w.out += struct.pack("<f" if kind == nbt.FLOAT else "<d", value)
        elif kind == nbt.STRING:
            text(value)
        elif kind == nbt.BYTES:
            w.number(len(value))
            w.out += bytes(value)
        elif kind in (nbt.INTS, nbt.LONGS):
            w.number(len(value))
            w.out += np.asarray(value).astype("<i4" if kind == nbt.INTS else "<i8").tobytes()
        elif kind == nbt.LIST:
            w.out.append(value[0])
            w.number(len(value[1]))
            for v in value[1]:
                put(value[0], v)
        elif kind == nbt.COMPOUND:
            shape = shapes[_shape(value)]
            w.number(shape)
            for i, (own, v) in enumerate(value.values()):
                put(own, v, forms.get((shape, i), "var"))

    w.number(len(documents))
    for name, (kind, value) in documents:
        text(name)
        w.out.append(kind)
        put(kind, value)
    return zlib.compress(bytes(w.out), 6)


def unpack(data: bytes) -> list[tuple[str, nbt.Tag]]:
    """The inverse of pack()."""
    r = _Reader(zlib.decompress(data))
    if r.number() != VERSION:
        raise nbt.BadTag("packed in a form that isn't known")
    pool = [r.text() for _ in range(r.number())]
    shapes = []
    for _ in range(r.number()):
        fields = []
        for _ in range(r.number()):
            name, kind = r.text(), r.take(1)[0]
            form = _FORMS[r.take(1)[0]] if kind in _WHOLE else "var"
            fields.append((name, kind, form, r.signed() if kind in _WHOLE and form == "const" else None))
        shapes.append(fields)

    def text() -> str:
        n = r.number()
        return pool[n - 1] if n else r.text()

    def get(kind: int, form: str = "var", const=None):
        if kind in _WHOLE:
            if form == "const":
                return const
            return r.signed() if form == "var" else struct.unpack(_STRUCT[form], r.take(struct.calcsize(_STRUCT[form])))[0]
        if kind in (nbt.FLOAT, nbt.DOUBLE):
            return struct.unpack("<f", r.take(4))[0] if kind == nbt.FLOAT else struct.unpack("<d", r.take(8))[0]
        if kind == nbt.STRING:
            return text()
        if kind == nbt.BYTES:
            return r.take(r.number())
        if kind in (nbt.INTS, nbt.LONGS):
            size = 4 if kind == nbt.INTS else 8
            return np.frombuffer(r.take(r.number() * size), f"<i{size}").astype(f"i{size}")
        if kind == nbt.LIST:
            own = r.take(1)[0]
            return own, [get(own) for _ in range(r.number())]
        if kind == nbt.COMPOUND:
            return {name: (own, get(own, form_, const_)) for name, own, form_, const_ in shapes[r.number()]}
        if kind == nbt.END:
            return None
        raise nbt.BadTag(f"unknown type {kind}")

    out = []
    for _ in range(r.number()):
        name, kind = text(), r.take(1)[0]
        out.append((name, (kind, get(kind))))
    return out


def pack_documents(df: DataFrame, group: str, order: str, document: str = "data") -> DataFrame:
    """(group, keys, packed): the documents (binary) of each group, in order; a group bounds what shares a dictionary."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "keys": [pdf[order].tolist()], "packed": [pack([nbt.read(bytes(d)) for d in pdf[document]])]})

    return df.select(group, order, document).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, keys array<{kinds[order]}>, packed binary")


def unpack_documents(df: DataFrame, order: str, document: str = "data") -> DataFrame:
    """(order, document) of pack_documents()."""
    kind = dict(df.dtypes)["keys"].removeprefix("array<").removesuffix(">")

    def run(parts):
        for pdf in parts:
            for keys, data in zip(pdf["keys"], pdf["packed"], strict=True):
                yield pd.DataFrame({order: list(keys), document: [nbt.write(tag, name) for name, tag in unpack(bytes(data))]})

    return df.select("keys", "packed").mapInPandas(run, f"{order} {kind}, {document} binary")
