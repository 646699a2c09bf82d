"""Pieces that the operators of this subpackage share.

Large exchanges carry packed numpy arrays ("blobs") instead of one row per window, so that a window costs
about ten bytes in a shuffle file and sorting is vectorised.  A blob row is ``(part, kind, payload)``; ``part`` is
the shuffle partition that it goes to, and the number of partitions is ``spark.sql.shuffle.partitions``, so that
each partition's share stays the same as the input grows with that setting.
"""

from __future__ import annotations

import ctypes
import gc
import re
import struct
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a task handles at once; the largest of its arrays has eight bytes for each of them.
FLUSH_BYTES = 8 << 20
#: Bytes of an Arrow batch that goes to a Python worker, unless the session sets a limit of its own.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BLOB_SCHEMA = "part int, kind int, payload binary"
BLOB = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
#: A null doc_id sorts after every other.
NO_ID = np.iinfo(np.int64).max

_U64 = np.uint64


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bound_batches(spark: SparkSession) -> None:
    """Batches of long texts or sets stay small: the limit of Spark's default (64 MB) becomes ``BATCH_BYTES``."""
    if spark.conf.get(_BATCH_KEY, "67108864b").rstrip("b") == "67108864":
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where it is unset, a folder of this machine if the master is local (tests), else an error: executors of other machines would write to their own disks."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="gridloom-"))
    return sc.getCheckpointDir()


#: Seconds between two collections of the driver's garbage, and when the last one was.
_COLLECT_S, _collected = 2.0, [0.0]


def let_go(spark: SparkSession) -> None:
    """Collects the driver's garbage, at most once in ``_COLLECT_S``: only then does Spark delete shuffle files and checkpoints that nothing refers to, and a driver with memory to spare seldom does it by itself."""
    if time.monotonic() - _collected[0] >= _COLLECT_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder; Spark deletes the files once nothing refers to them (``let_go``) if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_folder(df.sparkSession)
    let_go(df.sparkSession)
    return df.checkpoint(eager=True)


def text_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *more) -> DataFrame:
    """(doc_id long, body binary, ``more``): null texts are empty; other columns are dropped, whatever their names."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"), *more)


def whole_row(docs: DataFrame, name: str = "row"):
    """The row's columns as one struct, to be carried through an operator, and the struct's field."""
    return F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias(name), T.StructField(name, docs.schema)


def schema_of(ddl: str, *more: T.StructField) -> T.StructType:
    return T.StructType([*T.StructType.fromDDL(ddl).fields, *more])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a DataFrame as Parquet into a new folder of the shared folder and reads it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    let_go(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a DataFrame of stored(), once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released() -> None:
    """Gives the memory that a task has freed back to the system: workers are used again, by tasks with other needs."""
    pa.default_memory_pool().release_unused()
    if "libc" not in _Z:
        _Z["libc"] = ctypes.CDLL(None)
    if hasattr(_Z["libc"], "malloc_trim"):
        _Z["libc"].malloc_trim(0)


def tidy(run):
    """``run`` (batches to batches), after which its memory is released."""

    def whole(batches):
        yield from run(batches)
        released()

    return whole


def exchange(df: DataFrame, n: int) -> DataFrame:
    """Each row goes to the partition that its column ``part`` names."""
    return df.repartitionById(n, F.col("part"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(32)
    x *= _U64(0xD6E8FEB86659FD93)
    x ^= x >> _U64(32)
    x *= _U64(0xD6E8FEB86659FD93)
    x ^= x >> _U64(32)
    return x


def group_of(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.view(_U64)) % _U64(n)).astype(np.int32)


_Z = {}


def zip_bytes(data) -> bytes:
    if "c" not in _Z:
        _Z["c"], _Z["d"] = zstandard.ZstdCompressor(level=4), zstandard.ZstdDecompressor()
    return _Z["c"].compress(data)


def unzip_bytes(data: bytes) -> bytes:
    if "d" not in _Z:
        zip_bytes(b"")
    return _Z["d"].decompress(data)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed string; bytes of equal significance stand together."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)), np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if a.itemsize > 1 else a.tobytes()]
    return zip_bytes(b"".join(out))


def unpack(payload: bytes) -> list[np.ndarray]:
    data, out, at = unzip_bytes(payload), [], 1
    for _ in range(data[0]):
        kind, n = struct.unpack_from("<2sQ", data, at)
        dtype = np.dtype("<" + kind.decode())
        at += 10
        raw = np.frombuffer(data, np.uint8, n * dtype.itemsize, at)
        at += n * dtype.itemsize
        out.append(raw.view(dtype) if dtype.itemsize == 1 else np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).view(dtype).ravel())
    return out


def steps(sorted_values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences from the value before; at ``starts`` the value itself."""
    out = np.diff(sorted_values, prepend=sorted_values.dtype.type(0))
    out[starts] = sorted_values[starts]
    return out


def unsteps(deltas: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The inverse of steps()."""
    total = np.cumsum(deltas)
    before = np.where(starts > 0, total[starts - 1], 0).astype(total.dtype) if len(starts) else total[:0]
    return (total - np.repeat(before, counts)).astype(deltas.dtype)


def blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], schema=BLOB)


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a binary array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


class Texts:
    """Documents of one flush, by rising doc_id: ids, tags (of the texts, so that rows that share an id stay apart), offsets, bytes, and a note that goes along with each if there are any."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, data: np.ndarray, tags: np.ndarray | None = None, notes: list[bytes] | None = None):
        self.ids, self.offsets, self.data, self.notes = ids, offsets, data, notes
        self.tags = tag_of(self) if tags is None else tags

    def __len__(self) -> int:
        return len(self.ids)

    def body(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def tag_of(texts: Texts) -> np.ndarray:
    import xxhash

    view, o = memoryview(np.ascontiguousarray(texts.data)), texts.offsets
    return np.array([xxhash.xxh32_intdigest(view[o[i] : o[i + 1]]) for i in range(len(texts.ids))], np.uint32)


def flushes(batches: Iterable[pa.RecordBatch], limit: int = FLUSH_BYTES) -> Iterator[Texts]:
    """Texts of about ``limit`` bytes, whole documents, from batches of (doc_id, body)."""
    kept, size = [], 0
    for batch in batches:
        body = batch.column(1)
        lengths = np.diff(binary_parts(body)[0])
        at = 0
        while at < len(batch):
            n = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), limit - size, side="right")))
            kept.append(batch.slice(at, n))
            size += int(lengths[at : at + n].sum())
            at += n
            if size >= limit or at < len(batch):
                yield _joined(kept)
                kept, size = [], 0
    if kept:
        yield _joined(kept)


def _joined(batches: list[pa.RecordBatch]) -> Texts:
    table = pa.Table.from_batches(batches)
    ids = table.column(0).combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    body = table.column(1).combine_chunks()
    order = np.argsort(ids, kind="stable")
    if (order[1:] < order[:-1]).any():
        ids, body = ids[order], body.take(pa.array(order))
    notes = [x.as_py() for x in table.column(2).combine_chunks().take(pa.array(order))] if table.num_columns > 2 else None
    return Texts(ids, *binary_parts(body), notes=notes)


def send_texts(texts: Texts, n: int, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """The documents as blobs by the group of their doc_id."""
    groups = group_of(texts.ids, n)
    lengths = np.diff(texts.offsets)
    for g in np.unique(groups):
        at = np.flatnonzero(groups == g)
        body = b"".join(texts.body(i) for i in at)
        notes = []
        if texts.notes is not None:
            own = [texts.notes[i] for i in at]
            notes = [np.array([len(x) for x in own], np.int64), np.frombuffer(b"".join(own), np.uint8)]
        yield int(g), kind, pack(texts.ids[at], texts.tags[at], lengths[at], np.frombuffer(body, np.uint8), *notes)


def received_texts(payload: bytes) -> Texts:
    ids, tags, lengths, data, *more = unpack(payload)
    notes = None
    if more:
        raw, cuts = more[1].tobytes(), np.r_[0, np.cumsum(more[0])].tolist()
        notes = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return Texts(ids, np.concatenate([[0], np.cumsum(lengths)]), data, tags, notes)


def joined_texts(parts: list[Texts]) -> Texts:
    """The documents of some flushes as one, by rising doc_id."""
    if len(parts) == 1:
        return parts[0]
    ids, tags = np.concatenate([t.ids for t in parts]), np.concatenate([t.tags for t in parts])
    bodies = [t.body(i) for t in parts for i in range(len(t))]
    order = np.argsort(ids, kind="stable")
    data = np.frombuffer(b"".join([bodies[i] for i in order.tolist()]), np.uint8)
    lengths = np.array([len(bodies[i]) for i in order.tolist()], np.int64)
    notes = [x for t in parts for x in t.notes] if parts[0].notes is not None else None
    return Texts(ids[order], np.r_[0, np.cumsum(lengths)], data, tags[order], notes and [notes[i] for i in order.tolist()])


def text_blobs(docs: DataFrame, n: int, kind: int = 9) -> DataFrame:
    """The documents of ``text_rows`` as blob rows, dealt by doc_id."""

    def run(batches):
        for texts in flushes(batches):
            if rows := list(send_texts(texts, n, kind)):
                yield blob_batch(rows)

    return docs.mapInArrow(tidy(run), BLOB_SCHEMA)


def send_places(docs: Texts, doc: np.ndarray, place: np.ndarray, n: int, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """Places (any rising numbers) in documents, as blobs by the group of the doc_id; doc and place are sorted."""
    if not len(doc):
        return
    yield from send_places_of(docs.ids[doc], docs.tags[doc], place, n, kind)


def send_places_of(ids: np.ndarray, tags: np.ndarray, place: np.ndarray, n: int, kind: int, extra: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes]]:
    """As send_places, with the id and tag of each place, and a small number for each if ``extra`` is given; the places of a document stand together, rising."""
    if not len(ids):
        return
    starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])
    counts = np.diff(np.r_[starts, len(ids)])
    groups = group_of(ids[starts], n)
    by = np.argsort(groups, kind="stable")
    cuts = np.flatnonzero(np.r_[True, groups[by][1:] != groups[by][:-1], True]) if len(by) else np.zeros(1, int)
    deltas = steps(place.astype(np.int64), starts).astype(np.uint32)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = by[a:b]
        at = ranges(starts[own], counts[own])
        yield int(groups[own[0]]), kind, pack(ids[starts[own]], tags[starts[own]], counts[own].astype(np.uint32), deltas[at], *([] if extra is None else [extra[at].astype(np.uint32)]))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for counts[0] numbers, then the same for the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


class Places:
    """Collects received places and gives those of a document."""

    def __init__(self):
        self.got: list[list[np.ndarray]] = []

    def add(self, payload: bytes) -> None:
        ids, tags, counts, deltas, *extra = unpack(payload)
        starts = np.cumsum(counts, dtype=np.int64) - counts
        self.got.append([np.repeat(ids, counts), np.repeat(tags, counts), unsteps(deltas.astype(np.int64), starts, counts), *extra])

    def close(self) -> None:
        cols = [np.concatenate(c) for c in zip(*self.got, strict=True)] if self.got else [np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)]
        order = np.lexsort((cols[2], cols[1], cols[0]))
        ids, tags, self.place, *extra = (c[order] for c in cols)
        self.extra = extra[0] if extra else np.zeros(0, np.uint32)
        starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]) if len(ids) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(ids)] if len(ids) else starts
        self.where = {(int(i), int(t)): (int(a), int(b)) for i, t, a, b in zip(ids[starts], tags[starts], starts, ends, strict=True)}
        self.got = []

    def of(self, doc_id: int, tag: int, extra: bool = False):
        a, b = self.where.get((int(doc_id), int(tag)), (0, 0))
        return (self.place[a:b], self.extra[a:b].astype(np.int64)) if extra else self.place[a:b]


def by_part(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)


def nullable(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def flagged_later(ids: np.ndarray, order: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of equal keys (``order`` sorts by key, ``starts`` begins each run): the smallest id of each element's run, in ``order``'s order, and the ids so ordered."""
    own = ids[order]
    least = np.minimum.reduceat(own, starts) if len(starts) else own
    return np.repeat(least, np.diff(np.r_[starts, len(own)])), own
