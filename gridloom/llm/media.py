"""Baseline JPEG columns: bytes stored as luminance samples, and DC-only luminance thumbnails read back in numpy.

Storing: a byte is the mean of an 8 by 8 block.  With a DC quantiser of 8 and no AC coefficients the DC value is
byte - 128 exactly, so the thumbnail that a DC-only reader makes is the payload itself, without loss.  Each row of 64
blocks is a restart interval.

Reading: markers are parsed, the entropy-coded data is cut at restart markers, and the Huffman codes of all intervals of
a batch of images are decoded in step, one block of every interval at a time.  A table over 16 bits resolves a DC code,
its magnitude and an end-of-block code at once; longer or other codes take a general path.  AC coefficients are skipped.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _common as c

ROW = 64
#: An image is at most 65,535 samples high: so many rows of blocks. A longer payload takes several images in a row.
IMAGE_ROWS = 8191
#: The DC luminance code lengths of the standard's annex K (categories 0 to 8 are needed here).
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
_U64 = np.uint64


class NotBaseline(ValueError):
    """Media that isn't a baseline JPEG."""


def codes_of(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """The (code, length) of each symbol of a Huffman table."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def _header(rows: int) -> bytes:
    def part(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    return b"".join([
        b"\xff\xd8",
        part(0xDB, b"\x00" + bytes([8] * 64)),
        part(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0])),
        part(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS),
        part(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00"),
        part(0xDD, struct.pack(">H", ROW)),
        part(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def _diff_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each difference + 255: DC code, magnitude and end of block (code 0, one bit) as one code, and its length."""
    codes = codes_of(DC_COUNTS, DC_SYMBOLS)
    value, length = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        value[d + 255] = (code << size | (d if d >= 0 else d + (1 << size) - 1)) << 1
        length[d + 255] = n + size + 1
    return value, length


_VALUE, _LENGTH = _diff_codes()


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as baseline JPEG images, one after the other if it is long."""
    rows = np.array([len(p) // ROW for p in payloads], np.int64)
    if any(len(p) % ROW or not p for p in payloads):
        raise ValueError("a payload must be a positive multiple of 64 bytes")
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).astype(np.int16) - 128
    diff = samples.copy()
    diff[:, 1:] -= samples[:, :-1]
    diff += 255
    value, length = _VALUE[diff], _LENGTH[diff]
    for _ in range(2):  # four codes of up to 15 bits make one of up to 60
        value = value[:, 0::2] << length[:, 1::2].astype(_U64) | value[:, 1::2]
        length = length[:, 0::2] + length[:, 1::2]
    pad = -length.sum(axis=1) % 8  # an interval is filled up with ones
    value = np.concatenate([value, ((_U64(1) << pad.astype(_U64)) - _U64(1))[:, None]], axis=1)
    length = np.concatenate([length, pad[:, None]], axis=1)
    sizes = length.sum(axis=1) // 8
    base = np.cumsum(sizes) - sizes
    first = base[:, None] * 8 + np.cumsum(length, axis=1) - length
    total = int(sizes.sum())
    out = np.zeros(total + 16, np.uint8)
    some = length > 0
    shift = (64 - length - (first & 7))[some]
    flat, at = value[some], (first >> 3)[some]
    left = np.maximum(shift, 0).astype(_U64)
    over = np.maximum(-shift, 0).astype(_U64)
    word = flat >> over << left
    for j in range(8):
        _or(out, at + j, (word >> _U64(56 - 8 * j)).astype(np.uint8))
    rest = over > 0
    if rest.any():
        _or(out, at[rest] + 8, (flat[rest] << (_U64(8) - over[rest])).astype(np.uint8))
    out = out[:total]
    full = out == 255  # a zero follows each byte of ones
    grown = np.cumsum(full) + np.arange(total)
    last = np.repeat(np.arange(len(sizes)) * 2, sizes)
    place = grown - full + last
    ends = np.r_[place[base[1:] - 1] if len(base) > 1 else np.zeros(0, np.int64), place[-1:]] + np.r_[full[base[1:] - 1] if len(base) > 1 else np.zeros(0, bool), full[-1:]] + 1
    stream = np.zeros(int(ends[-1]) + 2, np.uint8)
    stream[place] = out
    number = np.arange(len(sizes)) - np.repeat(np.cumsum(rows) - rows, rows)
    within = number % IMAGE_ROWS
    image_end = (within == IMAGE_ROWS - 1) | (number == np.repeat(rows, rows) - 1)
    stream[ends] = 255
    stream[ends + 1] = np.where(image_end, 0xD9, 0xD0 + within % 8)
    raw, media = stream.tobytes(), []
    stop = (ends + 2).tolist()
    at_row = at_byte = 0
    for r in rows.tolist():
        parts = []
        for a in range(0, r, IMAGE_ROWS):
            b = min(a + IMAGE_ROWS, r)
            parts += [_header(b - a), raw[at_byte : stop[at_row + b - 1]]]
            at_byte = stop[at_row + b - 1]
        at_row += r
        media.append(b"".join(parts))
    return media


def _or(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """out[at] |= values for bits that no two values share; at rises."""
    if not len(at):
        return
    heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    out[at[heads]] |= np.bitwise_or.reduceat(values, heads)


@dataclass
class Image:
    """A parsed image: what its scan needs, and then its thumbnail."""

    width: int
    height: int
    components: list[tuple[int, int, int]] = field(default_factory=list)  # horizontal and vertical factor, quantiser of DC
    tables: tuple = ()
    order: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC table, AC table of the scan
    restart: int = 0
    data: bytes = b""
    thumbnail: np.ndarray | None = None

    @property
    def mcus(self) -> tuple[int, int]:
        """Across and down."""
        h = max(x[0] for x in self.components) if len(self.order) > 1 else 1
        v = max(x[1] for x in self.components) if len(self.order) > 1 else 1
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(media: bytes) -> list[Image]:
    """The images of a media value, one after the other."""
    images, at = [], 0
    while at < len(media):
        image, at = _parse_one(media, at)
        images.append(image)
    if not images:
        raise NotBaseline("empty")
    return images


def _parse_one(media: bytes, at: int) -> tuple[Image, int]:
    if media[at : at + 2] != b"\xff\xd8":
        raise NotBaseline("no start of image")
    at += 2
    quant: dict[int, int] = {}
    huff: dict[int, tuple[bytes, bytes]] = {}
    image, restart = None, 0
    try:
        while True:
            if media[at] != 0xFF:
                raise NotBaseline("no marker")
            marker = media[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            size = struct.unpack_from(">H", media, at + 2)[0]
            body = media[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + 64 * (2 if wide else 1) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huff[body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1):
                _, h, w, n = struct.unpack_from(">BHHB", body)
                image = Image(w, h)
                ids = [body[6 + 3 * i] for i in range(n)]
                image.components = [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, quant[body[8 + 3 * i]]) for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise NotBaseline("not a baseline frame")
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                if image is None:
                    raise NotBaseline("a scan without a frame")
                image.order = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, 16 + (body[2 + 2 * i] & 15)) for i in range(body[0])]
                if len(image.order) != len(image.components):
                    raise NotBaseline("several scans")
                image.restart = restart
                image.tables = tuple((k, *huff[k]) for k in sorted({t for x in image.order for t in x[1:]}))
                end = at
                while True:
                    end = media.index(b"\xff", end)
                    if media[end + 1] == 0 or 0xD0 <= media[end + 1] <= 0xD7:
                        end += 2
                    else:
                        break
                image.data = media[at:end]
                if media[end + 1] != 0xD9:
                    raise NotBaseline("more than one scan")
                return image, end + 2
    except (IndexError, KeyError, struct.error, ValueError) as error:
        raise NotBaseline(str(error)) from error


def _tables(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, code length) by the next 16 bits; length 0: no code."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, n) in codes_of(counts, symbols).items():
        symbol[code << 16 - n : code + 1 << 16 - n] = s
        length[code << 16 - n : code + 1 << 16 - n] = n
    return symbol, length


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


_FAST: dict = {}


def _block_table(dc: tuple[bytes, bytes], ac: tuple[bytes, bytes]):
    """Single tables, and by the next 16 bits (difference, bits of the whole block) if the block's codes fit and it has no AC coefficients; bits 0 otherwise."""
    if (dc, ac) not in _FAST:
        (ds, dl), (as_, al) = _tables(*dc), _tables(*ac)
        x = np.arange(1 << 16)
        size = ds
        bits = x >> np.maximum(16 - dl - size, 0) & (1 << size) - 1
        used = dl + size
        rest = x << np.minimum(used, 16) & 0xFFFF
        good = (dl > 0) & (used < 16) & (al[rest] > 0) & (as_[rest] == 0) & (used + al[rest] <= 16)
        _FAST[dc, ac] = (ds, dl, as_, al, _signed(bits, size).astype(np.int32), np.where(good, used + al[rest], 0).astype(np.int32))
    return _FAST[dc, ac]


def read(images: list[Image]) -> None:
    """Sets the thumbnail (rows of luminance means, one for each block) of each image."""
    groups: dict = {}
    for image in images:
        groups.setdefault((image.tables, tuple(image.order), tuple(x[:2] for x in image.components), image.restart), []).append(image)
    for own in groups.values():
        _read_group(own)


def _read_group(images: list[Image]) -> None:
    first = images[0]
    huff = {k: (counts, symbols) for k, counts, symbols in first.tables}
    raw = np.frombuffer(b"".join(x.data + b"\xff\xd7" for x in images), np.uint8)  # a marker ends each image's last interval
    mark = np.flatnonzero(raw[:-1] == 255)
    mark = mark[raw[mark + 1] >= 0xD0]
    keep = np.ones(len(raw), bool)
    keep[1:] = ~((raw[1:] == 0) & (raw[:-1] == 255))
    keep[mark] = keep[mark + 1] = False
    data = np.r_[raw[keep], np.full(24, 255, np.uint8)]
    ends = np.cumsum(keep)[mark]
    pos = np.r_[0, ends[:-1]] * 8
    limit = ends * 8
    mcus = np.array([x.mcus[0] * x.mcus[1] for x in images], np.int64)
    step = first.restart or int(mcus.max())
    intervals = -(-mcus // step)
    if int(intervals.sum()) != len(pos):
        raise NotBaseline("restart markers are missing")
    number = np.arange(len(pos)) - np.repeat(np.cumsum(intervals) - intervals, intervals)
    many = np.minimum(step, np.repeat(mcus, intervals) - number * step)
    blocks = [(1, 1) if len(first.order) == 1 else first.components[x[0]][:2] for x in first.order]
    luma = blocks[0][0] * blocks[0][1]
    width = int(many.max()) * luma
    dcs = np.zeros((len(pos), width), np.int32)
    pred = [np.zeros(len(pos), np.int32) for _ in blocks]
    word = np.ndarray((len(data) - 8,), ">u8", data, strides=(1,))
    bound = len(data) - 9
    whole = np.arange(len(pos))
    for m in range(int(many.max())):
        at = whole if (many > m).all() else np.flatnonzero(many > m)
        for k, (_, dc, ac) in enumerate(first.order):
            table = _block_table(huff[dc], huff[ac])
            for b in range(blocks[k][0] * blocks[k][1]):
                own = pos[at]
                w = word[np.minimum(own >> 3, bound)].astype(_U64) << (own & 7).astype(_U64)
                top = (w >> _U64(48)).astype(np.int64)
                diff, used = table[4][top], table[5][top]
                slow = np.flatnonzero(used == 0)
                pos[at] = own + used
                if len(slow):
                    diff = diff.copy()
                    diff[slow], pos[at[slow]] = _slow_block(word, bound, own[slow], table)
                pred[k][at] += diff
                if k == 0:
                    dcs[at, m * luma + b] = pred[0][at]
    if (pos > limit).any():
        raise NotBaseline("the data ends early")
    i = 0
    h, v = blocks[0]
    for image, n in zip(images, intervals.tolist(), strict=True):
        across, down = image.mcus
        flat = dcs[i : i + n].reshape(-1)[: across * down * luma] if n == 1 or width == step * luma else np.concatenate([dcs[i + j, : many[i + j] * luma] for j in range(n)])
        i += n
        grid = flat[: across * down * luma].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        grid = grid[: -(-image.height // 8), : -(-image.width // 8)]
        image.thumbnail = np.clip((grid * image.components[first.order[0][0]][2] + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def _slow_block(word, bound, pos, table) -> tuple[np.ndarray, np.ndarray]:
    """One block for each position, code by code."""
    ds, dl, as_, al = table[:4]
    pos = pos.copy()

    def top(p):
        return word[np.minimum(p >> 3, bound)].astype(_U64) << (p & 7).astype(_U64)

    w = top(pos)
    x = (w >> _U64(48)).astype(np.int64)
    if (dl[x] == 0).any():
        raise NotBaseline("no such code")
    size = ds[x]
    bits = (w << dl[x].astype(_U64) >> _U64(1) >> (63 - size).astype(_U64)).astype(np.int64)
    diff = _signed(bits, size)
    pos += dl[x] + size
    k = np.ones(len(pos), np.int64)
    while len(open_ := np.flatnonzero(k < 64)):
        x = (top(pos[open_]) >> _U64(48)).astype(np.int64)
        if (al[x] == 0).any():
            raise NotBaseline("no such code")
        s = as_[x]
        pos[open_] += al[x] + (s & 15)
        k[open_] = np.where(s == 0, 64, k[open_] + (s >> 4) + 1)
    return diff, pos


def mean_hash(thumbnail: np.ndarray) -> int:
    """64 bits: which cells of an 8 by 8 grid are brighter than the grid's mean."""
    rows, cols = thumbnail.shape
    y, x = np.arange(9) * rows // 8, np.arange(9) * cols // 8
    ny, nx = np.maximum(np.diff(y), 1), np.maximum(np.diff(x), 1)
    cells = np.add.reduceat(np.add.reduceat(thumbnail.astype(np.int64), y[:8], axis=0), x[:8], axis=1)
    mean = cells / (ny[:, None] * nx[None, :])
    return int(np.packbits((mean > mean.mean()).ravel()).view(">u8")[0])


def text_to_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): each whole text's UTF-8 bytes, with bytes 0 up to a positive multiple of 64, as baseline JPEG.

    Null texts are empty (64 bytes 0).  Payloads of more than 524,224 bytes take several images, one after the other.
    Repeated rows and rows without doc_id are kept; an empty table gives an empty result; other columns are ignored, whatever
    their names.
    """

    def run(batches):
        for batch in batches:
            for part in _bounded(batch, 4 << 20):
                bodies = part.column(1).to_pylist()
                media = store([b + bytes(-len(b) % ROW or (0 if b else ROW)) for b in bodies])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(b) for b in bodies], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return c.text_rows(docs, text, doc_id).mapInArrow(c.tidy(run), "doc_id long, n_bytes long, media binary")


def _bounded(batch: pa.RecordBatch, limit: int, column: int = 1):
    sizes = np.diff(c.binary_parts(batch.column(column))[0])
    at = 0
    while at < len(batch):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), limit, side="right")))
        yield batch.slice(at, n)
        at += n


FEATURES = "width long, height long, thumbnail binary, thumbnail_hash string"


def media_features(media: DataFrame, *keep: str, column: str = "media") -> DataFrame:
    """The columns ``keep``, then width, height, thumbnail (binary: the DC-only luminance samples, row by row) and thumbnail_hash (16 hex digits) of each media value.

    A value of several images counts as one image of their joint height (their widths must agree).  What is null or no
    baseline JPEG of one scan has nulls.
    """
    schema = media.select(*keep).schema if keep else None
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema) if schema else ""

    def run(batches):
        for batch in batches:
            for part in _bounded(batch.set_column(len(keep), "media", batch.column(len(keep)).fill_null(b"")), 6 << 20, len(keep)):
                found: list[list[Image] | None] = []
                for value in part.column(len(keep)).to_pylist():
                    try:
                        found.append(parse(value))
                    except NotBaseline:
                        found.append(None)
                try:
                    read([x for own in found if own for x in own])
                except NotBaseline:
                    found = [_alone(own) for own in found]
                rows = [_feature(own) for own in found]
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *cols], names=[*keep, "width", "height", "thumbnail", "thumbnail_hash"])

    return media.select(*keep, F.col(column).alias("_media")).mapInArrow(c.tidy(run), fields + FEATURES)


def _alone(images: list[Image] | None) -> list[Image] | None:
    try:
        if images:
            read(images)
        return images
    except NotBaseline:
        return None


def _feature(images: list[Image] | None):
    if not images or len({x.width for x in images}) > 1:
        return None, None, None, None
    luma = images[0].thumbnail if len(images) == 1 else np.concatenate([x.thumbnail for x in images])
    return images[0].width, sum(x.height for x in images), luma.tobytes(), f"{mean_hash(luma):016x}"


def media_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text as media, reads it back and digests both: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    stored = text_to_media(docs, doc_id, text)
    found = media_features(stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media"), "doc_id", "n_bytes", "media_bytes", "media_sha256")
    return found.select(
        "doc_id", "n_bytes", F.octet_length("thumbnail").cast("long").alias("payload_bytes"), F.sha2("thumbnail", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(thumbnail, -64, 64)")).alias("tail_crc32"), "media_bytes", "media_sha256",
        F.concat_ws(":", F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")), "thumbnail_hash").alias("feature"),
    )
