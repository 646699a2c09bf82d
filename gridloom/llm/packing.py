"""Best-fit packing of documents into bins of fixed size, under conflicts.

A bin holds at most one document of a source and one of a duplicate cluster.  Documents longer than a bin are cut into
pieces, which are of one source and so lie in different bins.  Items come by falling size.  Open bins are kept by
residual room; each carries a bitmap of its sources and one of its clusters.  The search starts at the least room that
suffices and goes on to the next larger (successor) until a bin fits without conflict: the tightest compatible one.
A room whose bins all conflict with a source or cluster is marked for it, so that a source or a group of copies that
holds a third of all documents doesn't search the same bins again.

Items are dealt by a hash to shards of about ``shard_items`` documents, each packed in one task; a shard wastes part of a
few last bins at most, and no task's memory grows with the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _common as c


@dataclass
class Bin:
    number: int
    room: int
    sources: int = 0
    clusters: int = 0
    items: int = 0


class BestFit:
    """Bins of one shard, by residual room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: dict[int, dict[int, Bin]] = {}
        self.open = 0  # bit r: some bin has room r
        self.blocked: dict[tuple[str, int], int] = {}  # bit r: every bin of room r conflicts
        self.marks: dict[int, set[tuple[str, int]]] = {}
        self.bits: dict[str, dict[object, int]] = {"s": {}, "c": {}}
        self.count = 0

    def bit(self, kind: str, key: object) -> int:
        own = self.bits[kind]
        return 1 << own.setdefault(key, len(own))

    def put(self, size: int, source: object, cluster: object) -> tuple[int, int]:
        """(bin, offset) of an item of ``size``; a cluster of None conflicts with nothing."""
        s = self.bit("s", source)
        k = 0 if cluster is None else self.bit("c", cluster)
        keys = (("s", s), ("c", k))
        levels = (self.open & ~self.blocked.get(keys[0], 0) & ~(self.blocked.get(keys[1], 0) if k else 0)) >> size
        room = size
        while levels:
            step = (levels & -levels).bit_length() - 1
            room += step
            own = self.rooms[room]
            by_source = by_cluster = True
            for found in own.values():
                if found.sources & s:
                    by_cluster &= bool(found.clusters & k)
                elif found.clusters & k:
                    by_source = False
                else:
                    del own[found.number]
                    if not own:
                        self.open &= ~(1 << room)
                        self._unmark(room, None)
                    offset = self.capacity - found.room
                    self._add(found, size, s, k)
                    return found.number, offset
            for blocked, key in ((by_source, keys[0]), (by_cluster and k, keys[1])):
                if blocked:
                    self.blocked[key] = self.blocked.get(key, 0) | 1 << room
                    self.marks.setdefault(room, set()).add(key)
            levels >>= step + 1
            room += 1
        found = Bin(self.count, self.capacity)
        self.count += 1
        self._add(found, size, s, k)
        return found.number, 0

    def _add(self, found: Bin, size: int, s: int, k: int) -> None:
        found.room -= size
        found.sources |= s
        found.clusters |= k
        found.items += 1
        self.rooms.setdefault(found.room, {})[found.number] = found
        self.open |= 1 << found.room
        self._unmark(found.room, found)

    def _unmark(self, room: int, new: Bin | None) -> None:
        """After a bin came to a room: marks that it contradicts go; after the last one left: all."""
        marks = self.marks.get(room)
        if marks:
            for key in [m for m in marks if new is None or not (new.sources if m[0] == "s" else new.clusters) & m[1]]:
                marks.discard(key)
                self.blocked[key] &= ~(1 << room)


def best_fit(docs: DataFrame, capacity: int = 2048, shard_items: int = 20_000, cluster: Column | None = None, size: Column | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, piece, start, size, bin, offset: where each piece of each row's text lies; sizes in words.

    ``cluster`` names the duplicate cluster of a row (default: a hash of the text).  A bin is ``shard-number``.
    Null and empty texts have one piece of size 0.  A null source is a source of its own, and so is each null cluster.
    Rows without doc_id and repeated rows are packed like any other; of items of one size the smaller doc_id comes first, then
    the smaller piece.  Texts longer than a bin are cut, so their length has no limit; an empty table gives an empty result.
    Other columns are ignored, whatever their names.
    """
    words = size if size is not None else F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(words, F.lit(0)).cast("long").alias("words"), (cluster if cluster is not None else F.xxhash64(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("cluster"))
    shards = max(1, math.ceil(docs.count() / shard_items))
    last = F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0)).cast("long")
    pieces = rows.select("doc_id", "source", "words", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select("doc_id", "source", "cluster", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("piece") * capacity).alias("size"))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(shards)).cast("int"))
    dealt = c.exchange(pieces, shards).sortWithinPartitions("part", F.desc("size"), "doc_id", "piece", "cluster", "source")

    def run(batches):
        shard, packed = None, None
        for batch in batches:
            part, doc, src, klass, size = (batch.column(k).to_pylist() for k in ("part", "doc_id", "source", "cluster", "size"))
            bins, offsets = [], []
            for p, _, s, k, n in zip(part, doc, src, klass, size, strict=True):
                if p != shard:
                    shard, packed = p, BestFit(capacity)
                number, offset = packed.put(n, s, k)
                bins.append(f"{p}-{number}")
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "piece", "start", "size")), pa.array(bins, pa.string()), pa.array(offsets, pa.int64())], names=["doc_id", "piece", "start", "size", "bin", "offset"])

    return dealt.mapInArrow(run, "doc_id long, piece long, start long, size long, bin string, offset long")
