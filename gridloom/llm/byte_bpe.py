"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the others.

The vocabulary is read on the driver and broadcast as a few arrays (its size is that of the vocabulary, not of the data).
In each batch, the pre-tokens not met before are looked up together in the perfect hash; those that are no vocabulary
entries are merged by rank: a heap holds the ranks of neighbouring pairs, a doubly linked list the symbols left.
A memo of bounded size holds results by pre-token.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import bound_batches, mix, tidy

#: Pre-tokens whose ids a worker remembers; then it starts anew.
MEMO = 1_000_000
_U64 = np.uint64


class PerfectHash:
    """A minimal perfect hash of byte strings (hash and displace): n keys get the slots 0 to n - 1."""

    def __init__(self, keys: list[bytes], values: Iterable[int]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 4)
        for self.seed in range(64):
            if self._place(keys):
                break
        else:
            raise ValueError("keys must be distinct")
        slots = self.slots(keys)
        self.keys: list[bytes] = [b""] * n
        self.values = np.zeros(n, np.int64)
        for slot, key, value in zip(slots.tolist(), keys, values, strict=True):
            self.keys[slot], self.values[slot] = key, value

    def _hashes(self, keys: list[bytes]) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(k, self.seed) for k in keys], _U64)

    def _place(self, keys: list[bytes]) -> bool:
        h = self._hashes(keys)
        if len(np.unique(h)) < len(keys):
            return False
        bucket = (h % _U64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        self.shift = np.zeros(self.buckets, np.int64)
        taken = np.zeros(self.n, bool)
        for b in np.argsort(-sizes, kind="stable").tolist():
            if sizes[b] < 2:
                break
            own = h[order[starts[b] : starts[b + 1]]]
            for d in range(0, 1 << 16, 64):
                at = self._slot(own[None, :], np.arange(d, d + 64)[:, None])
                free = ~taken[at].any(axis=1)
                same = np.sort(at, axis=1)
                free &= (same[:, 1:] != same[:, :-1]).all(axis=1)
                if free.any():
                    k = int(free.argmax())
                    self.shift[b] = d + k
                    taken[at[k]] = True
                    break
            else:
                return False
        single = np.flatnonzero(sizes == 1)
        self.shift[single] = -1 - np.flatnonzero(~taken)[: len(single)]
        return True

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mix(h ^ d.astype(_U64) * _U64(0x9E3779B97F4A7C15)) % _U64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        h = self._hashes(keys)
        d = self.shift[(h % _U64(self.buckets)).astype(np.int64)]
        return np.where(d < 0, -1 - d, self._slot(h, np.maximum(d, 0)))

    def find(self, keys: list[bytes]) -> list[int]:
        """The value of each key, or -1."""
        if not keys or not self.n:
            return [-1] * len(keys)
        slots = self.slots(keys).tolist()
        own, values = self.keys, self.values
        return [int(values[s]) if own[s] == k else -1 for s, k in zip(slots, keys, strict=True)]


class BytePairEncoder:
    """Encodes and decodes by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.hash = PerfectHash(list(ranks), ranks.values())
        self.pattern = pattern
        self.token = {r: t for t, r in ranks.items()}
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        if min(self.single) < 0:
            raise ValueError("the vocabulary lacks single bytes")
        self._start()

    def _start(self) -> None:
        self.memo: dict[str, bytes] = {}
        self.pairs: dict[int, int] = {}
        self.split = regex.compile(self.pattern).findall

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "pairs", "split")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._start()

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairEncoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Merges the neighbouring pair of the lowest rank, the leftmost of equals, until none is in the vocabulary."""
        n = len(piece)
        sym = [self.single[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, pair = self.pairs, self._pair
        rank = [0] * n
        for i in range(n - 1):
            r = pairs.get(sym[i] << 24 | sym[i + 1])
            rank[i] = pair(sym[i], sym[i + 1]) if r is None else r
        rank[n - 1] = -1
        heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i, r = x & 0xFFFFFFFF, x >> 32
            if rank[i] != r:
                continue
            j = after[i]
            sym[i], rank[j], sym[j] = r, -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = pairs.get(r << 24 | sym[k])
                rank[i] = new = pair(r, sym[k]) if new is None else new
                if new >= 0:
                    push(heap, new << 32 | i)
            else:
                rank[i] = -1
            h = before[i]
            if h >= 0:
                new = pairs.get(sym[h] << 24 | r)
                rank[h] = new = pair(sym[h], r) if new is None else new
                if new >= 0:
                    push(heap, new << 32 | h)
        return [s for s in sym if s >= 0]

    def _pair(self, a: int, b: int) -> int:
        r = self.hash.find([self.token[a] + self.token[b]])[0]
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        self.pairs[a << 24 | b] = r
        return r

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        pieces = [self.split(text) for text in texts]
        distinct: set[str] = set()
        for own in pieces:
            distinct.update(own)
        if len(self.memo) >= MEMO:
            self.memo = {}
        memo = self.memo
        new = [p for p in distinct if p not in memo]
        raw = [p.encode() for p in new]
        for p, b, r in zip(new, raw, self.hash.find(raw), strict=True):
            memo[p] = r.to_bytes(4, "little") if r >= 0 else array("I", self.merge(b)).tobytes()
        get = memo.__getitem__
        return [b"".join(map(get, own)) for own in pieces]

    def decode(self, ids: bytes) -> bytes:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode_decode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids binary: little-endian 32-bit numbers, decoded binary) for each row of ``docs``.

    ``path`` is a vocabulary of ranks (base64 token, blank, rank on each line), ``pattern`` the regular expression whose
    matches are encoded separately; special tokens are ordinary text.  Null texts count as empty, and empty texts have
    no ids.  Long texts count whole, repeated rows and rows without doc_id are kept, an empty table gives an empty result, and
    other columns are ignored, whatever their names.
    """
    return _mapped(docs, path, pattern, doc_id, text, lambda ids, raw: (ids, raw), {"ids": pa.binary(), "decoded": pa.binary()}, "ids binary, decoded binary")


def encode_digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As encode_decode, with digests made where the ids are: n_tokens, ids_sha256, decoded_sha256."""
    sha = hashlib.sha256
    return _mapped(docs, path, pattern, doc_id, text, lambda ids, raw: (len(ids) // 4, sha(ids).hexdigest(), sha(raw).hexdigest()), {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(docs, path, pattern, doc_id, text, make, kinds, schema):
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(BytePairEncoder.load(path, pattern))

    def run(batches):
        encoder = shared.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = encoder.encode(part.column(1).to_pylist())
                rows = [make(x, encoder.decode(x)) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values()))], names=["doc_id", *kinds])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id long, {schema}")
