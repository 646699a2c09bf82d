"""Named binary tags: reading, writing, printing, and as JSON for variants.

A tag is a pair (type, value): numbers; bytes; str; a list as (element type, values); a compound as a dict of tags;
arrays of ints or longs as numpy arrays.
"""

from __future__ import annotations

import gzip
import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The types' numbers.
END, BYTE, SHORT, INT, LONG, FLOAT, DOUBLE, BYTES, STRING, LIST, COMPOUND, INTS, LONGS = range(13)
#: How deep tags may nest.
MAX_DEPTH = 256
_NUMBERS = {BYTE: ">B", SHORT: ">h", INT: ">i", LONG: ">q", FLOAT: ">f", DOUBLE: ">d"}
_SUFFIX = {BYTE: "b", SHORT: "s", LONG: "L", FLOAT: "f"}

Tag = tuple[int, object]


class BadTag(ValueError):
    """Bytes that are no tag."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, form: str):
        try:
            out = struct.unpack_from(form, self.data, self.at)[0]
        except struct.error as error:
            raise BadTag("the data ends early") from error
        self.at += struct.calcsize(form)
        return out

    def bytes(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise BadTag("the data ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def text(self) -> str:
        return self.bytes(self.number(">H")).decode("utf-8", "surrogatepass")

    def value(self, kind: int, depth: int = 0):
        if depth > MAX_DEPTH:
            raise BadTag("tags nest too deep")
        if kind in _NUMBERS:
            return self.number(_NUMBERS[kind])
        if kind == BYTES:
            return self.bytes(self.number(">i"))
        if kind == STRING:
            return self.text()
        if kind == LIST:
            element, n = self.number(">B"), self.number(">i")
            return element, [self.value(element, depth + 1) for _ in range(n)] if element else []
        if kind == COMPOUND:
            out: dict[str, Tag] = {}
            while own := self.number(">B"):
                name = self.text()
                out[name] = (own, self.value(own, depth + 1))
            return out
        if kind in (INTS, LONGS):
            form = ">i4" if kind == INTS else ">i8"
            n = self.number(">i")
            return np.frombuffer(self.bytes(n * int(form[2])), form).astype(form[1:])
        raise BadTag(f"unknown type {kind}")


def read(data: bytes) -> tuple[str, Tag]:
    """(name, tag) of a whole document."""
    r = _Reader(bytes(data))
    kind = r.number(">B")
    if kind == END:
        return "", (END, None)
    name = r.text()
    return name, (kind, r.value(kind))


def _body(tag: Tag, out: list[bytes], depth: int = 0) -> None:
    kind, value = tag
    if depth > MAX_DEPTH:
        raise BadTag("tags nest too deep")
    if kind in _NUMBERS:
        out.append(struct.pack(_NUMBERS[kind], value & 255 if kind == BYTE else value))
    elif kind == BYTES:
        out += [struct.pack(">i", len(value)), bytes(value)]
    elif kind == STRING:
        out.append(_text(value))
    elif kind == LIST:
        element, values = value
        out.append(struct.pack(">Bi", element if values else END, len(values)))
        for v in values:
            _body((element, v), out, depth + 1)
    elif kind == COMPOUND:
        for name, own in value.items():
            out += [bytes([own[0]]), _text(name)]
            _body(own, out, depth + 1)
        out.append(b"\0")
    elif kind in (INTS, LONGS):
        out += [struct.pack(">i", len(value)), np.asarray(value).astype(">i4" if kind == INTS else ">i8").tobytes()]
    else:
        raise BadTag(f"unknown type {kind}")


def _text(value: str) -> bytes:
    raw = value.encode("utf-8", "surrogatepass")
    return struct.pack(">H", len(raw)) + raw


def write(tag: Tag, name: str = "") -> bytes:
    out = [bytes([tag[0]]), _text(name)]
    _body(tag, out)
    return b"".join(out)


def of(value) -> Tag:
    """A tag of a plain Python value: int (INT, or LONG if it needs it), float, bool, str, bytes, list, dict."""
    if isinstance(value, bool):
        return BYTE, int(value)
    if isinstance(value, int):
        return (INT if -(1 << 31) <= value < 1 << 31 else LONG), value
    if isinstance(value, float):
        return DOUBLE, value
    if isinstance(value, str):
        return STRING, value
    if isinstance(value, bytes):
        return BYTES, value
    if isinstance(value, np.ndarray):
        return (INTS if value.dtype.itemsize == 4 else LONGS), value
    if isinstance(value, dict):
        return COMPOUND, {k: of(v) for k, v in value.items()}
    own = [of(v) for v in value]
    kinds = {k for k, _ in own}
    if kinds == {INT, LONG}:
        kinds = {LONG}
    if len(kinds) > 1:
        raise BadTag("a list holds values of one type")
    return LIST, (min(kinds, default=END), [v for _, v in own])


def plain(tag: Tag):
    """The value as JSON has it."""
    kind, value = tag
    if kind == COMPOUND:
        return {k: plain(v) for k, v in value.items()}
    if kind == LIST:
        return [plain((value[0], v)) for v in value[1]]
    if kind in (INTS, LONGS):
        return np.asarray(value).tolist()
    if kind == BYTES:
        return list(value)
    if kind in (FLOAT, DOUBLE) and not np.isfinite(value):
        return str(value)
    return value


def pretty(tag: Tag, name: str = "", indent: int = 0) -> str:
    """Readable text: a suffix for each type of number, 32 numbers of an array in a line."""
    pad, (kind, value) = "  " * indent, tag
    head = f"{pad}{json.dumps(name)}: " if name else pad
    if kind == COMPOUND:
        return head + "{\n" + ",\n".join(pretty(v, k, indent + 1) for k, v in value.items()) + f"\n{pad}}}"
    if kind == LIST:
        element, values = value
        if element in _NUMBERS:
            return head + "[" + _lines([_number(element, v) for v in values], pad) + "]"
        return head + "[\n" + ",\n".join(pretty((element, v), "", indent + 1) for v in values) + f"\n{pad}]" if values else head + "[]"
    if kind in (INTS, LONGS, BYTES):
        return head + "[" + _lines([str(int(v)) for v in value], pad) + "]"
    return head + (json.dumps(value, ensure_ascii=False) if kind == STRING else _number(kind, value))


def _lines(values: list[str], pad: str) -> str:
    rows = [", ".join(values[i : i + 32]) for i in range(0, len(values), 32)]
    return rows[0] if len(rows) == 1 else "".join(f"\n{pad}  {r}," for r in rows)[:-1] + f"\n{pad}" if rows else ""


def _number(kind: int, value) -> str:
    text = repr(float(np.float32(value)) if kind == FLOAT else value) if kind in (FLOAT, DOUBLE) else str(value)
    if kind in (FLOAT, DOUBLE) and "." not in text and np.isfinite(value) and "e" not in text:
        text += ".0"
    return text + _SUFFIX.get(kind, "")


def detect(data: bytes) -> tuple[str, Tag]:
    """A document that may be gzipped, deflated or plain."""
    data = bytes(data)
    for unpack in (gzip.decompress, zlib.decompress, bytes):
        try:
            return read(unpack(data))
        except (OSError, EOFError, zlib.error, BadTag, UnicodeDecodeError):
            continue
    raise BadTag("no document")


def compressed(tag: Tag, name: str = "") -> bytes:
    """A whole document, gzipped, the same bytes each time."""
    return gzip.compress(write(tag, name), 6, mtime=0)


def documents(data: bytes) -> list[tuple[str, Tag]]:
    """The documents of a file: one that may be gzipped, deflated or plain, else those of a region file's chunks."""
    try:
        found = detect(data)
        if found[1][0] == END:
            raise BadTag("no document")
        return [found]
    except BadTag:
        from gridloom.sources.region import read_chunks

        try:
            found = [read(chunk) for _, _, _, chunk in read_chunks(bytes(data))]
        except (ValueError, OSError, EOFError, zlib.error, struct.error) as error:
            raise BadTag("neither a document nor a region file") from error
        if not found:
            raise
        return found


@F.pandas_udf(T.StringType())
def _to_json(data: pd.Series) -> pd.Series:
    def one(x):
        try:
            return None if x is None else json.dumps(plain(detect(x)[1]), ensure_ascii=False)
        except BadTag:
            return None

    return data.map(one)


def to_variant(data: Column) -> Column:
    """A document's bytes as a variant; null for what is no document."""
    return F.try_parse_json(_to_json(data))


@F.pandas_udf(T.StringType())
def to_text(data: pd.Series) -> pd.Series:
    """A file's documents as readable text; null for what holds none."""

    def one(x):
        try:
            return None if x is None else "\n".join(pretty(tag) for _, tag in documents(x))
        except BadTag:
            return None

    return data.map(one)


@F.pandas_udf(T.BinaryType())
def from_json(text: pd.Series) -> pd.Series:
    """A document from JSON text."""
    return text.map(lambda x: None if x is None else write(of(json.loads(x))))
