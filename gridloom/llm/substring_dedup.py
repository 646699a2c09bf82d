"""Substring dedup by Rabin-Karp hashes of every window of ``window`` words.

Every window of every document is hashed (two polynomial hashes of the words' hashes), the occurrences of each hash
meet in one Spark partition, and an occurrence is repeated if a document with a smaller doc_id holds the same window.
Repeated windows that overlap merge into maximal removal intervals.

Plan: (1) a scan hashes; within a flush, occurrences that follow a smaller doc_id are settled at once, and only those of
the smallest doc_id travel, so a window that a third of all documents share costs one entry for each flush;
(2) partitions by hash find the smallest doc_id; (3) the settled places meet the texts, dealt by doc_id.
Each exchange is keyed by the partition number itself; no group is ever collected.

A window is compared by 80 bits (64 of one hash, 16 of another) and by the partition number, which comes from the second:
86 bits with 64 partitions.  At 30 GB of input there are some 4.6e9 windows and 1.1e19 pairs of them, so the chance that any
two different ones agree is 1 in 7 million; at 100 TB (1.5e13 windows, 2^18 partitions) it is 1 in 3,000.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _common as c

_U64 = np.uint64
_BASES = (_U64(0x9E3779B97F4A7C15), _U64(0xC2B2AE3D27D4EB4F))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HASHES, _PLACES, _TEXTS = 0, 1, 9


def words_of(texts: c.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each word of all the documents, in order; the number of words of each document)."""
    return words_and_places(texts)[:2]


def words_and_places(texts: c.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words_of(), and the first byte of each word and the byte after it."""
    n = len(texts)
    offsets, data = texts.offsets, texts.data
    size = len(data) + n
    view, cuts = memoryview(np.ascontiguousarray(data)), offsets.tolist()
    buf = np.frombuffer(b" ".join([view[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]) + b" " * 9, np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    first, last = edge[0::2], edge[1::2]
    counts = np.bincount(np.searchsorted(offsets[1:] + np.arange(1, n + 1), first, side="right"), minlength=n)[:n] if n else np.zeros(0, int)
    length = last - first
    h = length.astype(_U64) * _U64(0x165667B19E3779F9)
    load = np.ndarray((size + 1,), "<u8", buf, strides=(1,))
    active = np.flatnonzero(length <= 256)
    at = 0
    while len(active):
        left = length[active] - at
        chunk = load[first[active] + at]
        chunk &= _U64(0xFFFFFFFFFFFFFFFF) >> (_U64(8) * (_U64(8) - np.minimum(left, 8).astype(_U64)))
        h[active] = c.mix((h[active] ^ chunk) * _U64(0xA0761D6478BD642F) + _U64(0xE7037ED1A0B428DB))
        active, at = active[left > 8], at + 8
    for i in np.flatnonzero(length > 256):
        h[i] = xxhash.xxh64_intdigest(buf[first[i] : last[i]].tobytes(), 7)
    shift = np.repeat(np.arange(n), counts)  # a blank stands after each document
    return h, counts, first - shift, last - shift


def windows_of(h: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, document, place) of each window; none crosses documents."""
    n = max(0, len(h) - window + 1)
    keys = []
    for base in _BASES:
        key = np.zeros(n, _U64)
        for j in range(window):
            key *= base
            key += h[j : j + n]
        keys.append(key)
    own = np.maximum(counts - window + 1, 0)
    starts = np.cumsum(counts) - counts
    at = c.ranges(starts, own)
    doc = np.repeat(np.arange(len(counts)), own)
    return keys[0][at], keys[1][at], doc, at - starts[doc]


def runs_of(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order by key and check, where each run of equal ones begins)."""
    order = np.argsort(key)
    ordered, more = key[order], check[order]
    same = ordered[1:] == ordered[:-1]
    if (same & (more[1:] != more[:-1])).any():  # hardly ever: the key alone sorts faster
        order = np.lexsort((check, key))
        ordered, more = key[order], check[order]
        same = (ordered[1:] == ordered[:-1]) & (more[1:] == more[:-1])
    return order, np.flatnonzero(np.r_[True, ~same])


def send_keys(texts: c.Texts, key: np.ndarray, key2: np.ndarray, doc: np.ndarray, place: np.ndarray, n: int) -> list[tuple[int, int, bytes]]:
    """Settles what one flush can settle and sends the rest by key; elements come by rising document and place."""
    rows: list[tuple[int, int, bytes]] = []
    if not len(key):
        return rows
    check = (key2 >> _U64(48)).astype(np.uint16)
    order, starts = runs_of(key, check)
    least, own = c.flagged_later(texts.ids[doc], order, starts)
    later = np.zeros(len(key), bool)
    later[order] = own > least
    rows += c.send_places(texts, doc[later], place[later], n, _PLACES)
    open_ = np.flatnonzero(~later)
    part = (c.mix(key2[open_]) % _U64(n)).astype(np.int32)
    by = open_[np.argsort(part, kind="stable")]
    cuts = np.r_[0, np.cumsum(np.bincount(part, minlength=n))]
    for p in range(n):
        at = by[cuts[p] : cuts[p + 1]]
        if len(at):
            heads = np.flatnonzero(np.r_[True, doc[at][1:] != doc[at][:-1]])
            own_docs, many = doc[at][heads], np.diff(np.r_[heads, len(at)])
            rows.append((p, _HASHES, c.pack(texts.ids[own_docs], texts.tags[own_docs], many.astype(np.uint32), c.steps(place[at].astype(np.int64), heads).astype(np.uint32), key[at], check[at])))
    return rows


def settle(batches, n: int):
    """In the partition of some hashes: passes on settled places, and settles the rest."""
    got: list[list[np.ndarray]] = []
    for _, kind, payload in c.by_part(batches):
        if kind == _PLACES:
            got_part = c.unpack(payload)
            yield c.blob_batch([(int(c.group_of(got_part[0][:1], n)[0]), _PLACES, payload)])
        else:
            ids, tags, many, deltas, key, check = c.unpack(payload)
            starts = np.cumsum(many, dtype=np.int64) - many
            got.append([np.repeat(ids, many), np.repeat(tags, many), c.unsteps(deltas.astype(np.int64), starts, many).astype(np.uint32), key, check])
    if not got:
        return
    ids, tags, place, key, check = (np.concatenate(x) for x in zip(*got, strict=True))
    got.clear()
    order, starts = runs_of(key, check)
    del key, check
    least, own = c.flagged_later(ids, order, starts)
    at = order[own > least]
    at = at[np.lexsort((place[at], tags[at], ids[at]))]
    if rows := list(c.send_places_of(ids[at], tags[at], place[at], n, _PLACES)):
        yield c.blob_batch(rows)


def with_places(places: DataFrame, docs: DataFrame, n: int, finish, schema: str, places_kind: int = _PLACES) -> DataFrame:
    """Deals places and texts by doc_id and hands ``finish`` each flush of texts with the places of its documents."""
    both = c.exchange(places.unionByName(c.text_blobs(docs, n, _TEXTS)), n).sortWithinPartitions("kind")

    def run(batches):
        places, closed, kept, size = c.Places(), False, [], 0
        for _, kind, payload in c.by_part(batches):
            if kind == places_kind:
                places.add(payload)
                continue
            if not closed:
                places.close()
                closed = True
            kept.append(c.received_texts(payload))
            size += len(kept[-1].data)
            if size >= c.FLUSH_BYTES:
                yield from finish(c.joined_texts(kept), places)
                kept, size = [], 0
        if kept:
            yield from finish(c.joined_texts(kept), places)

    return both.mapInArrow(c.tidy(run), schema)


def repeated_words(docs: DataFrame, window: int = 13) -> DataFrame:
    """Blob rows with the places (first words) of the windows of each document that a smaller doc_id holds too."""
    n = c.partitions(docs.sparkSession)

    def hashes(batches):
        for texts in c.flushes(batches):
            h, counts = words_of(texts)
            if rows := send_keys(texts, *windows_of(h, counts, window), n):
                yield c.blob_batch(rows)

    sent = docs.mapInArrow(c.tidy(hashes), c.BLOB_SCHEMA)
    return c.exchange(sent, n).mapInArrow(c.tidy(lambda batches: settle(batches, n)), c.BLOB_SCHEMA)


def covered(places: np.ndarray, window: int, size: int) -> np.ndarray:
    """Which of ``size`` units a window that starts at one of the places covers."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, places, 1)
    np.add.at(change, np.minimum(places + window, size), -1)
    return np.cumsum(change[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each run of set flags."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edge[0::2], edge[1::2]


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without(body: bytes, mask: np.ndarray) -> bytes:
    """The text without the words that are set in mask, and without the white space after each; the rest as it was."""
    out, at = [], 0
    spans = [m.span() for m in _WORD.finditer(body)]
    for a, b in zip(*runs(mask), strict=True):
        out.append(body[at : spans[a][0]])
        at = spans[b][0] if b < len(spans) else len(body)
    return b"".join(out) + body[at:]


def substring_dedup(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", note: Column | None = None) -> DataFrame:
    """Removes repeated windows of words.

    Returns one row for each row of ``docs``: doc_id, n_words, n_removed, removed (maximal intervals of word numbers, end
    exclusive), kept (text: the words left, joined by one space), kept_sha256, left (the text as it was, without the
    removed words), note (a string of the row that goes along, if asked for).

    Null texts count as empty and give empty results; a null doc_id sorts after every other, so that its words can be
    removed but remove nobody's.  Rows that share a doc_id don't affect each other.  Long texts count whole; empty tables give empty results;
    other columns of ``docs`` are ignored, whatever their names.
    """
    rows = c.text_rows(docs, text, doc_id)
    n = c.partitions(docs.sparkSession)

    def finish(texts: c.Texts, places: c.Places):
        out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "removed", "kept", "kept_sha256", "left")}
        for i in range(len(texts)):
            body = texts.body(i)
            words = body.split()
            at, cut = places.of(texts.ids[i], texts.tags[i]), []
            if len(at):
                mask = covered(at, window, len(words))
                kept = b" ".join([w for w, m in zip(words, mask.tolist(), strict=True) if not m])
                cut = [{"start": int(a), "end": int(b)} for a, b in zip(*runs(mask), strict=True)]
                removed = int(mask.sum())
                body = without(body, mask)
            else:
                kept, removed = b" ".join(words), 0
            for k, v in zip(out, (len(words), removed, cut, kept, hashlib.sha256(kept).hexdigest(), body), strict=True):
                out[k].append(v)
        long, string = pa.int64(), pa.string()
        kinds = {"n_words": long, "n_removed": long, "removed": pa.list_(pa.struct([("start", long), ("end", long)])), "kept": string, "kept_sha256": string, "left": string}
        cols = [pa.array(out[k], pa.binary()).cast(t) if k in ("kept", "left") else pa.array(out[k], t) for k, t in kinds.items()]
        notes = [pa.array(texts.notes, pa.binary()).cast(string)] if texts.notes is not None else []
        yield pa.RecordBatch.from_arrays([c.nullable(texts.ids), *cols, *notes], names=["doc_id", *kinds, *(["note"] if notes else [])])

    schema = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string, kept_sha256 string, left string"
    source = rows
    if note is not None:
        source = c.text_rows(docs, text, doc_id, F.coalesce(note, F.lit("")).cast("binary").alias("note"))
        schema += ", note string"
    return with_places(repeated_words(rows, window), source, n, finish, schema)
