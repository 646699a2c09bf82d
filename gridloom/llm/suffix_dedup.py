"""Suffix-array dedup of bytes: a distributed difference-cover sort, then a comparison of adjacent prefixes.

A suffix array of the whole corpus takes tens of bytes of shuffle for each byte of text.  Only suffixes whose first
``length`` bytes (50) occur in two documents matter, so:

1. Routing.  Every window of ``length`` bytes has a key: the smallest hash of its 20-byte grams.  Equal windows have
   equal keys.  A run of windows with one key is one entry (1 for about 16 bytes); entries of each key meet in one
   partition, and runs whose key occurs in one document only are dropped.  Their suffixes can't share a prefix.
2. Sort.  The contexts of the runs left (the bytes that their windows cover) are dealt by key and sorted there by
   difference cover: the positions 1 and 2 (mod 3) are the sample; their triples of 8-byte characters are sorted and
   named (24 bytes), the recursion sorts triples of those names (72 bytes, more than ``length``, so it ends there), and
   the other suffixes merge by their first byte and the rank of the sampled suffix after it.  Suffixes that are
   neighbours in that order and agree in ``length`` bytes - compared byte by byte - form a class; its smallest doc_id
   removes the windows of all later documents.
3. The places go back to the texts, dealt by doc_id.

Hot groups: of what is the same within a flush of about 8 MB (a key in step 1; a context in step 2) one entry travels.
A context that many documents hold enters the sort once, with its holders.  But a passage with other surroundings in each
document gives as many contexts of one key.  So the keys that very many documents have (told from a sample of the
documents, which only balances the work: any choice of keys gives the same result) are split: each of their windows is a context
by itself, routed by its own hash, and of equal ones in a flush one travels.  Keys only route; bytes decide.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _common as c
from gridloom.llm.substring_dedup import runs, with_places

_U64 = np.uint64
_GRAM, _BLOCK = 20, 1 << 16
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
_OPEN, _KNOWN, _PLACES, _TEXTS = 0, 1, 2, 9
#: Bytes of contexts that are sorted at once, unless one key has more.
SORT_BYTES = 1 << 19
#: A key is split if so many of one in ``HOT_SAMPLE`` documents have it: about 65,000 documents, some 5 MB of contexts.
HOT_SAMPLE, HOT_DOCS = 1024, 64


def window_keys(data: np.ndarray, length: int) -> np.ndarray:
    """The smallest hash of the grams of each window; len(data) - length + 1 of them."""
    h = _TABLE[data]
    size, m = 1, 0x9E3779B97F4A7C15
    four = None
    while size < 16:
        h = h[:-size] * _U64(m) + h[size:]
        size *= 2
        m = m * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF
        if size == 4:
            four = h
    h = h[:-4] * _U64(m) + four[16 : 16 + len(h) - 4]
    h ^= h >> _U64(29)
    h *= _U64(0xBF58476D1CE4E5B9)
    h ^= h >> _U64(32)
    want, size = length - _GRAM + 1, 1
    while size * 2 <= want:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (want - size)], h[want - size :])


def window_runs(texts: c.Texts, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, number of windows, key) of each run of windows with one key."""
    data, offsets = texts.data, texts.offsets
    total = len(data) - length + 1
    own = np.maximum(np.diff(offsets) - length + 1, 0)
    if total <= 0 or not own.any():
        e = np.zeros(0, np.int64)
        return e, e, e, e.view(_U64)
    edge = np.zeros(total, bool)
    edge[offsets[:-1][own > 0]] = True
    change = np.zeros(total + 1, np.int8)
    change[offsets[:-1][own > 0]] += 1
    change[(offsets[:-1] + own)[own > 0]] -= 1
    valid = np.cumsum(change[:-1], dtype=np.int8).view(bool)
    starts, keys = [], []
    for a in range(0, total, _BLOCK):
        b, back = min(a + _BLOCK, total), min(a, 1)
        k = window_keys(data[a - back : b + length - 1], length)
        new = np.ones(b - a, bool)
        new[1 - back :] = k[1:] != k[:-1]
        at = np.flatnonzero((new | edge[a:b]) & valid[a:b])
        starts.append(at + a)
        keys.append(k[at + back])
    start, key = np.concatenate(starts), np.concatenate(keys)
    doc = np.searchsorted(offsets, start, side="right") - 1
    end = (offsets[:-1] + own)[doc]
    end[:-1] = np.where(doc[1:] == doc[:-1], start[1:], end[:-1])
    return doc, start - offsets[doc], end - start, key


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return (c.mix(key ^ _U64(0x5851F42D4C957F2D)) % _U64(n)).astype(np.int32)


def _runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    ordered = keys[order]
    return order, np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])


def shared_runs(docs: DataFrame, length: int) -> DataFrame:
    """Blob rows with the first windows of the runs whose key another document has too."""
    n = c.partitions(docs.sparkSession)

    def send(batches):
        for texts in c.flushes(batches):
            doc, start, _, key = window_runs(texts, length)
            if not len(key):
                continue
            rows = []
            order, heads = _runs_of(key)
            ids = texts.ids[doc][order]
            size = np.diff(np.r_[heads, len(key)])
            several = np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads)
            shared = np.zeros(len(key), bool)
            shared[order] = np.repeat(several, size)
            rows += c.send_places(texts, doc[shared], start[shared], n, _PLACES)
            known = key[order][heads[several]]
            part = _bucket(known, n)
            for p in np.unique(part):
                rows.append((int(p), _KNOWN, c.pack(known[part == p])))
            open_ = np.flatnonzero(~shared)
            part = _bucket(key[open_], n)
            by = open_[np.argsort(part, kind="stable")]
            cuts = np.r_[0, np.cumsum(np.bincount(part, minlength=n))]
            for p in range(n):
                at = by[cuts[p] : cuts[p + 1]]
                if len(at):
                    first = np.flatnonzero(np.r_[True, doc[at][1:] != doc[at][:-1]])
                    d = doc[at][first]
                    rows.append((p, _OPEN, c.pack(texts.ids[d], texts.tags[d], np.diff(np.r_[first, len(at)]).astype(np.uint32), c.steps(start[at], first).astype(np.uint32), key[at])))
            yield c.blob_batch(rows)

    def settle(batches):
        got, known = [], []
        for _, kind, payload in c.by_part(batches):
            if kind == _KNOWN:
                known.append(c.unpack(payload)[0])
            elif kind == _PLACES:
                yield c.blob_batch([(int(c.group_of(c.unpack(payload)[0][:1], n)[0]), _PLACES, payload)])
            else:
                ids, tags, many, deltas, key = c.unpack(payload)
                first = np.cumsum(many, dtype=np.int64) - many
                got.append((np.repeat(ids, many), np.repeat(tags, many), c.unsteps(deltas.astype(np.int64), first, many).astype(np.uint32), key))
        if not got:
            return
        ids, tags, start, key = (np.concatenate(x) for x in zip(*got, strict=True))
        got.clear()
        order, heads = _runs_of(key)
        own = ids[order]
        several = np.minimum.reduceat(own, heads) != np.maximum.reduceat(own, heads)
        if known:
            several |= np.isin(key[order][heads], np.concatenate(known))
        at = order[np.repeat(several, np.diff(np.r_[heads, len(key)]))]
        at = at[np.lexsort((start[at], tags[at], ids[at]))]
        if rows := list(c.send_places_of(ids[at], tags[at], start[at].astype(np.int64), n, _PLACES)):
            yield c.blob_batch(rows)

    return c.exchange(docs.mapInArrow(c.tidy(send), c.BLOB_SCHEMA), n).mapInArrow(c.tidy(settle), c.BLOB_SCHEMA)


def hot_keys(docs: DataFrame, length: int) -> np.ndarray:
    """The sorted keys that at least ``HOT_DOCS`` of one in ``HOT_SAMPLE`` documents have."""

    def run(batches):
        for texts in c.flushes(batches):
            doc, _, _, key = window_runs(texts, length)
            order = np.lexsort((doc, key))
            once = order[np.r_[True, (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])]] if len(key) else order
            keys, n = np.unique(key[once], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id", "body"), F.lit(HOT_SAMPLE)) == 0)
    found = some.mapInArrow(c.tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_DOCS).collect()
    return np.sort(np.array([r.key for r in found], np.int64).view(_U64))


def ranked(values: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones."""
    order = np.argsort(values)
    ordered = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
    return out


def suffix_classes(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes of ``text`` at ``starts`` by difference cover, to a depth of 72 bytes.

    Gives their order and, in that order, the number of the class of each: neighbours that agree in ``length`` (50 to
    72) bytes are of one class.
    """
    size = len(text)
    padded = np.concatenate([text, np.zeros(160, np.uint8)])
    word = np.ndarray((size + 152,), ">u8", padded, strides=(1,))
    need = np.zeros(size + 128, bool)
    for j in range(3):
        need[starts + j] = True
    need[0::3] = False  # positions 1 and 2 (mod 3) are the sample
    sample = np.flatnonzero(need)
    for j in (24, 48):
        need[sample + j] = True
    named = np.flatnonzero(need)
    chars = np.zeros(size + 152, bool)
    for j in (0, 8, 16):
        chars[named + j] = True
    at = np.flatnonzero(chars)
    char = np.zeros(size + 152, np.int64)
    char[at] = ranked(word[at].astype(_U64))
    bits = int(char.max()).bit_length()
    if 3 * bits <= 63:
        triple = char[named] << 2 * bits | char[named + 8] << bits | char[named + 16]
    else:
        triple = ranked(char[named] << 32 | char[named + 8]) << 32 | char[named + 16]
    name = np.zeros(size + 152, np.int64)
    name[named] = ranked(triple)
    bits = int(name.max()).bit_length()
    if 3 * bits <= 63:
        triple = name[sample] << 2 * bits | name[sample + 24] << bits | name[sample + 48]
    else:
        triple = ranked(name[sample] << 32 | name[sample + 24]) << 32 | name[sample + 48]
    rank = name  # of the sampled suffixes, to 72 bytes
    rank[sample] = ranked(triple)

    byte = padded.astype(np.int64)
    own = [np.flatnonzero(starts % 3 == r) for r in range(3)]
    pos = [starts[x] for x in own]
    one = [byte[pos[r]] << 32 | rank[pos[r] + 1] for r in (0, 1)]
    two = {r: byte[pos[r]] << 40 | byte[pos[r] + 1] << 32 | rank[pos[r] + 2] for r in (0, 2)}
    self_ = {r: rank[pos[r]] for r in (1, 2)}
    one_s, two_s, self_s = [np.sort(x) for x in one], {r: np.sort(x) for r, x in two.items()}, {r: np.sort(x) for r, x in self_.items()}
    before = np.empty(len(starts), np.int64)
    find = np.searchsorted
    before[own[0]] = find(one_s[0], one[0]) + find(one_s[1], one[0]) + find(two_s[2], two[0])
    before[own[1]] = find(self_s[1], self_[1]) + find(one_s[0], one[1]) + find(self_s[2], self_[1])
    before[own[2]] = find(self_s[2], self_[2]) + find(two_s[0], two[2]) + find(self_s[1], self_[2])
    order = np.argsort(before)
    s = starts[order]
    differ = np.zeros(max(0, len(s) - 1), bool)
    for j in [*range(0, length - 7, 8), length - 8]:
        w = word[s + j]
        differ |= w[1:] != w[:-1]
    return order, np.cumsum(np.r_[False, differ])


def shared_contexts(docs: DataFrame, length: int) -> DataFrame:
    """Blob rows with the contexts of the shared runs, dealt by key, and with windows that a flush settles (as runs)."""
    n, hot = c.partitions(docs.sparkSession), hot_keys(docs, length)

    def contexts(texts: c.Texts, places: c.Places):
        doc, start, many, key = window_runs(texts, length)
        if not len(key):
            return
        shared = np.zeros(len(key), bool)
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            at = places.of(texts.ids[i], texts.tags[i])
            if len(at):
                shared[cuts[i] + np.searchsorted(start[cuts[i] : cuts[i + 1]], at)] = True
        at = np.flatnonzero(shared)
        if not len(at):
            return
        body = texts.data.tobytes()
        split = np.isin(key[at], hot) if len(hot) else np.zeros(len(at), bool)
        if split.any():
            own = at[split]
            windows = [np.repeat(doc[own], many[own]), c.ranges(start[own], many[own])]
            hashes = np.array([xxhash.xxh64_intdigest(body[a : a + length]) for a in (texts.offsets[windows[0]] + windows[1]).tolist()], _U64)
            doc, start, many, key = (np.concatenate([x[at[~split]], y]) for x, y in zip((doc, start, many, key), (*windows, np.ones(len(hashes), np.int64), hashes), strict=True))
            at = np.lexsort((start, doc))
        first = (texts.offsets[doc[at]] + start[at]).tolist()
        seen: dict[bytes, int] = {}
        least = np.empty(len(at), np.int64)
        for j, (a, b, i) in enumerate(zip(first, (many[at] + length - 1).tolist(), texts.ids[doc[at]].tolist(), strict=True)):
            least[j] = seen.setdefault(body[a : a + b], i)
        later = texts.ids[doc[at]] > least
        rows = list(_send_runs(texts.ids[doc[at[later]]], texts.tags[doc[at[later]]], start[at[later]], many[at[later]], n))
        rows = [(p, _PLACES, x) for p, _, x in rows]
        at = at[~later]
        part = _bucket(key[at], n)
        for p in np.unique(part):
            own = at[part == p]
            heads = np.flatnonzero(np.r_[True, doc[own][1:] != doc[own][:-1]])
            d = doc[own][heads]
            begin = texts.offsets[doc[own]] + start[own]
            data = texts.data[c.ranges(begin, many[own] + length - 1)]
            rows.append((int(p), _OPEN, c.pack(texts.ids[d], texts.tags[d], np.diff(np.r_[heads, len(own)]).astype(np.uint32), c.steps(start[own], heads).astype(np.uint32), many[own].astype(np.uint32), key[own], data)))
        if rows:
            yield c.blob_batch(rows)

    return with_places(shared_runs(docs, length), docs, n, contexts, c.BLOB_SCHEMA, places_kind=_PLACES)


def repeated_bytes(docs: DataFrame, length: int) -> DataFrame:
    """Blob rows with the windows (first byte; as runs) of each document that a smaller doc_id holds too."""
    n = c.partitions(docs.sparkSession)

    def sort(batches):
        got = []
        for _, kind, payload in c.by_part(batches):
            if kind == _PLACES:
                yield c.blob_batch([(int(c.group_of(c.unpack(payload)[0][:1], n)[0]), _PLACES, payload)])
            else:
                got.append(payload)
        if got:
            yield from _sorted(got, length, n)

    return c.exchange(shared_contexts(docs, length), n).mapInArrow(c.tidy(sort), c.BLOB_SCHEMA)


def _send_runs(ids, tags, start, many, n):
    """Runs of windows as blobs by doc_id; those of a document rise."""
    return c.send_places_of(ids, tags, start, n, _PLACES, extra=many)


def _sorted(payloads: list[bytes], length: int, n: int):
    """The sort and the comparison in one partition, some keys at a time."""
    cols, bodies, base = [], [], 0
    for payload in payloads:
        ids, tags, held, deltas, many, key, data = c.unpack(payload)
        first = np.cumsum(held, dtype=np.int64) - held
        size = many.astype(np.int64) + length - 1
        cols.append((np.repeat(ids, held), np.repeat(tags, held), c.unsteps(deltas.astype(np.int64), first, held), many.astype(np.int64), key, np.cumsum(size) - size + base))
        bodies.append(data)
        base += len(data)
    payloads.clear()
    ids, tags, start, many, key, at = (np.concatenate(x) for x in zip(*cols, strict=True))
    body = np.concatenate(bodies)
    del cols, bodies
    order = np.lexsort((ids, key))
    size = many + length - 1
    heads = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1], True])
    weight = np.cumsum(size[order])
    out: list[tuple[np.ndarray, ...]] = []
    a = 0
    while a < len(heads) - 1:
        before = int(weight[heads[a] - 1]) if heads[a] else 0
        b = max(a + 1, int(np.searchsorted(weight[heads[a + 1 :] - 1], before + SORT_BYTES, side="right")) + a)
        out += _sorted_keys(order[heads[a] : heads[b]], ids, tags, start, many, at, body, length)
        a = b
    if out:
        i, t, s, m = (np.concatenate(x) for x in zip(*out, strict=True))
        by = np.lexsort((s, t, i))
        yield c.blob_batch(list(_send_runs(i[by], t[by], s[by], m[by], n)))


def _sorted_keys(chosen, ids, tags, start, many, at, body, length):
    """chosen: entries by key and doc_id.  Gives (ids, tags, first windows, numbers of windows) of what is repeated."""
    size = many[chosen] + length - 1
    raw = body[c.ranges(at[chosen], size)].tobytes()
    ends = np.cumsum(size)
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(raw[e - s : e], len(number)) for s, e in zip(size.tolist(), ends.tolist(), strict=True)], np.int64)
    first = np.unique(which, return_index=True)[1]  # the first holder has the smallest doc_id
    text = np.frombuffer(b"".join(number), np.uint8)
    own = ids[chosen[first]]
    windows = many[chosen[first]]
    begin = np.cumsum(windows + length - 1) - (windows + length - 1)
    starts = c.ranges(begin, windows)
    of = np.repeat(np.arange(len(first)), windows)
    order, klass = suffix_classes(text, starts, length)
    heads = np.flatnonzero(np.r_[True, klass[1:] != klass[:-1]])
    least = np.empty(len(starts), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(own[of[order]], heads), np.diff(np.r_[heads, len(order)]))
    origin = np.cumsum(windows) - windows
    # each holder of a context has its windows: those with a smaller doc_id in their class are repeated
    held = many[chosen]
    slot = c.ranges(origin[which], held)
    entry = np.repeat(np.arange(len(chosen)), held)
    hit = ids[chosen][entry] > least[slot]
    if not hit.any():
        return []
    offset = slot - origin[which][entry]
    new = np.flatnonzero(hit & np.r_[True, (entry[1:] != entry[:-1]) | ~hit[:-1]])
    stop = np.flatnonzero(hit & np.r_[(entry[1:] != entry[:-1]) | ~hit[1:], True])
    e = chosen[entry[new]]
    return [(ids[e], tags[e], start[e] + offset[new], stop - new + 1)]


def suffix_dedup(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Removes each byte that is covered by a string of ``length`` (50 to 72) bytes that starts in a smaller doc_id too.

    Returns one row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, spans (maximal removed runs of bytes,
    end exclusive), kept (binary: the bytes left), kept_sha256.

    Null texts are empty; texts of fewer than ``length`` bytes stay whole.  A null doc_id sorts after every other, so
    that its bytes can be removed but remove nobody's.  Rows that share a doc_id don't affect each other.  Other columns
    of ``docs`` are ignored, whatever their names.  Long texts count whole; an empty table gives an empty result.
    """
    if not 50 <= length <= 72:
        raise ValueError("length must be from 50 to 72")
    rows = c.text_rows(docs, text, doc_id)
    n = c.partitions(docs.sparkSession)

    def finish(texts: c.Texts, places: c.Places):
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256")}
        for i in range(len(texts)):
            body = texts.data[texts.offsets[i] : texts.offsets[i + 1]]
            first, many = places.of(texts.ids[i], texts.tags[i], extra=True)
            a = b = np.zeros(0, np.int64)
            if len(first):
                change = np.zeros(len(body) + 1, np.int32)
                np.add.at(change, first, 1)
                np.add.at(change, np.minimum(first + many + length - 1, len(body)), -1)
                mask = np.cumsum(change[:-1]) > 0
                a, b = runs(mask)
                kept = body[~mask].tobytes()
            else:
                kept = body.tobytes()
            spans = [{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)]
            for k, v in zip(out, (len(body), int((b - a).sum()), len(a), spans, kept, hashlib.sha256(kept).hexdigest()), strict=True):
                out[k].append(v)
        long = pa.int64()
        kinds = {"n_bytes": long, "n_removed": long, "n_spans": long, "spans": pa.list_(pa.struct([("start", long), ("end", long)])), "kept": pa.binary(), "kept_sha256": pa.string()}
        yield pa.RecordBatch.from_arrays([c.nullable(texts.ids), *(pa.array(out[k], t) for k, t in kinds.items())], names=["doc_id", *kinds])

    return with_places(repeated_bytes(rows, length), rows, n, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string", places_kind=_PLACES)
