"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, a check of the Hamming distance.

A fingerprint's 64 bits fall into ``max_distance + 3`` blocks.  Two fingerprints with at most ``max_distance`` differing
bits agree in three blocks or more, so each fingerprint goes to every choice of three blocks (20 choices of 32 bits for
distance 3).  Fingerprints that agree in a choice stand together after a sort; links are found among them by a
breadth-first search that compares only with what is not yet reached, and only one link for each newly reached
fingerprint is emitted: no pairs are.  Equal fingerprints are one fingerprint here, so copies cost nothing.

A run of more than ``run_limit`` fingerprints isn't gathered: its members go to a further round, split by another block
of their remaining bits (again by pigeonhole, so no link is lost), until every run is small.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _common as c
from gridloom.llm.components import components

_U64 = np.uint64
_ALL = (1 << 64) - 1
_STEP = 1 << 15


def shingle_hashes(body: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``size`` words of lower-cased (A-Z) text; the whole sequence if it has fewer words."""
    words = body.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(x) for x in zip(*(words[j:] for j in range(size)), strict=False)]
    h = xxhash.xxh64_intdigest
    return np.array([h(s, 42) for s in shingles], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The fingerprint: each bit that is set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        part = np.ascontiguousarray(hashes[at : at + _STEP])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) of each row."""

    def run(batches):
        for batch in batches:
            body = batch.column(1)
            fps = np.array([majority_bits(shingle_hashes(x.as_buffer().to_pybytes() if x.as_buffer() is not None else b"", shingle)) for x in body], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return c.text_rows(docs, text, doc_id).mapInArrow(c.tidy(run), "doc_id long, fp long")


def masks_of(max_distance: int) -> list[int]:
    """A mask of bits for each choice of three blocks."""
    blocks = max_distance + 3
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [x | y | z for x, y, z in combinations(own, 3)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def finer(mask: int, pieces: int) -> list[int]:
    """The mask with one of ``pieces`` parts of the remaining bits added, for each part."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [round(len(free) * i / pieces) for i in range(pieces + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def linked(fps: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Links that join what is connected among some fingerprints, one for each but the first of a component."""
    out, rest = [], np.unique(fps)
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        root = int(frontier[0])
        while len(frontier) and len(rest):
            new = np.zeros(len(rest), bool)
            for at in range(0, len(frontier), 64):
                open_ = np.flatnonzero(~new)
                near = np.bitwise_count(rest[open_][None, :] ^ frontier[at : at + 64, None]) <= max_distance
                new[open_[near.any(axis=0)]] = True
            frontier, rest = rest[new], rest[~new]
            out += [(root, int(x)) for x in frontier]
    return out


def _links_round(rows: DataFrame, max_distance: int, run_limit: int) -> DataFrame:
    """rows: (key, mask, fp), each run of a key in one partition.  Gives (kind 0, a, b, -) for links and (kind 1, key, mask, fp) for what must be split."""

    def out(kind, a, b, x):
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(x, pa.int64())], names=["kind", "a", "b", "x"])

    def split(mask: np.ndarray, fp: np.ndarray):
        for m in np.unique(mask):
            own = fp[mask == m].view(_U64)
            for new in finer(int(m) & _ALL, max_distance + 1):
                key = c.mix(c.mix(own & _U64(new)) ^ _U64(new)).view(np.int64)
                yield out(np.full(len(own), 1), key, np.full(len(own), signed(new)), own.view(np.int64))

    def settle(key, fp):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, len(key)])
        two = starts[size == 2]
        x, y = fp[two], fp[two + 1]
        near = (np.bitwise_count(x.view(_U64) ^ y.view(_U64)) <= max_distance) & (x != y)
        a, b = x[near].tolist(), y[near].tolist()
        for s, k in zip(starts[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            for p, q in linked(fp[s : s + k].view(_U64), max_distance):
                a.append(signed(p))
                b.append(signed(q))
        if a:
            yield out(np.zeros(len(a)), a, b, np.zeros(len(a)))

    def run(batches):
        kept, huge = None, None  # the run that may go on in the next batch; the key of a run that is too long
        for batch in batches:
            key, mask, fp = (batch.column(i).to_numpy() for i in range(3))
            if not len(key):
                continue
            if huge is not None:
                n = int(np.searchsorted(key != huge, True)) if (key != huge).any() else len(key)
                yield from split(mask[:n], fp[:n])
                key, mask, fp = key[n:], mask[n:], fp[n:]
                if not len(key):
                    continue
                huge = None
            if kept is not None:
                key, mask, fp = (np.concatenate(x) for x in zip(kept, (key, mask, fp), strict=True))
            cut = len(key) - int((key == key[-1])[::-1].argmin() or len(key)) if (key != key[-1]).any() else 0
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[starts, len(key)])
            for s, k in zip(starts[size > run_limit].tolist(), size[size > run_limit].tolist(), strict=True):
                yield from split(mask[s : s + k], fp[s : s + k])
            good = np.repeat(size <= run_limit, size)
            good[cut:] = False
            yield from settle(key[good], fp[good])
            kept = (key[cut:], mask[cut:], fp[cut:])
            if len(kept[0]) > run_limit:
                huge, kept = key[-1], None
        if kept is not None:
            yield from settle(kept[0], kept[2])

    return rows.mapInArrow(run, "kind int, a long, b long, x long")


def fingerprint_links(fps: DataFrame, max_distance: int = 3, run_limit: int = 4096) -> DataFrame:
    """(a, b): links that connect whatever fingerprints (column fp, distinct) differ in at most ``max_distance`` bits."""
    spark = fps.sparkSession
    masks = F.array(*(F.lit(signed(m)).cast("long") for m in masks_of(max_distance)))
    rows = fps.select("fp", F.explode(masks).alias("mask")).select(F.xxhash64(F.col("fp").bitwiseAND(F.col("mask")), "mask").alias("key"), "mask", "fp")
    found = []
    for _ in range(16):
        dealt = rows.repartition(c.partitions(spark), "key").sortWithinPartitions("key")
        out = c.checkpoint(_links_round(dealt, max_distance, run_limit))
        found.append(out.filter("kind = 0").select("a", "b"))
        rows = out.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("mask"), F.col("x").alias("fp"))
        if rows.isEmpty():
            break
    else:
        raise RuntimeError("runs of a block could not be split")
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def simhash_near_duplicates(docs: DataFrame, shingle: int = 5, max_distance: int = 3, run_limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    fingerprint: 16 hex digits of the SimHash of the word shingles.  Fingerprints that differ in at most
    ``max_distance`` bits are linked; component_id is the smallest doc_id reachable, itself included.

    Null and empty texts have fingerprint zero, and are linked like any other.  Rows without doc_id have a fingerprint and
    join components but are never a component_id (null where a component has no other rows).  Repeated rows are kept, long
    texts count whole, an empty table gives an empty result, and other columns are ignored, whatever their names.
    """
    fps = c.checkpoint(fingerprints(docs, shingle, doc_id, text))
    own = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(own.select("fp"), max_distance, run_limit)).withColumnRenamed("node", "fp")
    classes = own.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = c.checkpoint(classes)
    whole = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(whole, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Words of 64 bits of a wide fingerprint, and how many of them go along for the check of the distance.
WIDE, CHECKED = 16, 4
#: Texts of up to so many shingles meet by the shingles themselves, not by blocks of the fingerprint.
SHORT = 32
#: How many standard errors further apart than expected two fingerprints may be: those that share a block, and short texts.
SLACK = (3.5, 4.5)
#: The least chance that a pair of the similarity asked for shares a block, with many shingles.
MEET = 0.99
#: Elements of sets in a stretch of a group that is searched exactly.
STRETCH = 1 << 19
#: Runs of up to so many members are compared together with others of their length, by shifts.
_SHIFTS = 8
_SALTS = np.random.default_rng(64).integers(1, 1 << 63, WIDE, dtype=np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """1,024 bits: for each, whether most of the distinct hashes, scrambled with the bit's word, have it set."""
    hashes = np.unique(hashes)
    if not len(hashes):
        return bytes(8 * WIDE)
    counts = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 255):
        part = c.mix(hashes[at : at + 255, None] ^ _SALTS[None, :])
        counts += np.add.reduce(np.unpackbits(part.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes()


def angle_bits(similarity: float, bits: int) -> int:
    """The expected number of differing bits of two sets of equal size and that Jaccard similarity, rounded."""
    return round(np.arccos(2 * similarity / (1 + similarity)) / np.pi * bits)


def differing(m: int, n: int, common: int) -> float:
    """The probability that a bit differs in the fingerprints of sets of m and n elements, so many of them common: ties count."""

    def odds(k):
        return np.array([math.comb(k, i) for i in range(k + 1)]) / 2.0**k

    def above(own, size):
        tail = np.r_[np.cumsum(odds(own)[::-1])[::-1], 0]
        return tail[np.clip(size // 2 + 1 - np.arange(common + 1), 0, own + 1)]

    a, b = above(m - common, m), above(n - common, n)
    return float((odds(common) * (a * (1 - b) + b * (1 - a))).sum())


def farthest(similarity: float, least: int, most: int, slack: float) -> int:
    """The distance of 256 bits that pairs of that similarity pass by no more than ``slack`` standard errors, the smaller set of ``least`` to ``most`` elements; beyond 128 the bits differ less than there."""
    worst = angle_bits(similarity, 1 << 20) / (1 << 20)
    for m in range(least, min(most, 128) + 1):
        for n in range(m, int(m / similarity + 1e-9) + 1):
            common = math.ceil(similarity / (1 + similarity) * (m + n) - 1e-9)
            if common <= m:
                worst = max(worst, differing(m, n, common))
    bits = 64 * CHECKED
    return min(bits, math.ceil(bits * worst + slack * math.sqrt(bits * worst * (1 - worst))))


def block_places(count: int, similarity: float) -> np.ndarray:
    """The bits of each block of a wide fingerprint (blocks by bits).

    Fingerprints that are unlike share a block's value with count / 2 ** width others: blocks are wide enough that these
    are at most 1,024, and so many that a pair of the similarity shares one with the chance ``MEET``.  Up to 67 million
    documents they are 64 blocks of 16 bits; wider ones take their bits from further orders of all 1,024.
    """
    width = max(16, 4 * math.ceil((math.log2(max(1, count)) - 10) / 4))
    agree = (1 - angle_bits(similarity, 1 << 20) / (1 << 20)) ** width
    blocks = math.ceil(math.log(1 - MEET) / math.log(1 - agree))
    each, rng = 64 * WIDE // width, np.random.default_rng(width)
    # blocks of further orders share bits with others
    blocks = each if blocks <= each else math.ceil(blocks * 1.2)
    orders = [np.arange(64 * WIDE) if t == 0 else rng.permutation(64 * WIDE) for t in range(-(-blocks // each))]
    return np.concatenate([o[: each * width].reshape(each, width) for o in orders])[:blocks]


def _sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(x.as_buffer().to_pybytes() if x.as_buffer() is not None else b"", shingle)) for x in column]


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, run_limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id) by wide SimHash fingerprints, for a Jaccard similarity of word shingles of ``similarity`` or more.

    Sixty-four bits tell a similarity of 0.8 from chance only at a distance that pigeonhole blocks can't serve: the
    expected distance is a seventh of the bits.  So a fingerprint has 1,024 bits here, in blocks (``block_places``): two
    documents of similarity 0.8 agree in at least one block with a probability of 0.99.  Documents that agree in a block are
    compared by the Hamming distance of 256 bits, with 3.5 standard errors of room (``SLACK``); the pairs left are
    linked if the similarity of their sets of shingles is in fact ``similarity`` or more.  Texts of up to ``SHORT`` shingles
    meet whoever shares one of their smallest shingles (so many that no pair of the similarity is missed) instead of a block,
    and have 4.5 standard errors of room.

    Of what is near in a block, links are emitted that join it (each member's first near one, and one more for each group
    that the member brings together), so a group gives links in proportion to its members.  Where the exact check then
    leaves such a group in parts, all its members of different parts are compared exactly.  A run of a block of more than
    ``run_limit`` members isn't held: its stretches are compared by themselves, and then its members of different parts with each
    other.  Both are dealt in tiles of two bounded stretches, so no task holds a group; no pair is left out.

    Copies (equal fingerprints) and repeated rows are one member.  Null and empty texts are copies of each other and are never
    linked to others; rows without doc_id have a null component_id; rows that share a doc_id are of one component.  Long
    texts count whole; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark, n = docs.sparkSession, c.partitions(docs.sparkSession)

    def prints(batches):
        for batch in batches:
            hashes = _sets(batch.column(1), shingle)
            # two sets of the similarity share one of each's smallest elements, so many of them
            some = [h[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1].tobytes() if 0 < len(h) <= partner else b"" for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([wide_fingerprint(h) for h in hashes], pa.binary()), pa.array([len(h) for h in hashes], pa.int64()), pa.array(some, pa.binary())], names=["doc_id", "wide", "size", "some"])

    partner = int(SHORT / similarity + 1e-9)
    fps = c.checkpoint(c.text_rows(docs, text, doc_id).mapInArrow(c.tidy(prints), "doc_id long, wide binary, size long, some binary"))
    own = fps.filter("doc_id is not null").groupBy("wide").agg(F.min("doc_id").alias("node"), F.max("size").alias("size"), F.max("some").alias("some"))
    most, short_most = farthest(similarity, SHORT + 1, 128, SLACK[0]), farthest(similarity, 1, SHORT, SLACK[1])
    places = block_places(fps.count(), similarity)
    parts_of = [f"c{i}" for i in range(CHECKED)]

    def blocks(batches):
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                wide = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(len(batch), -1)
                node, part = batch.column(1).to_numpy(), np.ascontiguousarray(wide[:, : 8 * CHECKED]).view(np.int64)
                real = np.flatnonzero(batch.column(2).to_numpy() > SHORT)
                bits = np.zeros((len(real), len(places), 32), np.uint8)
                bits[:, :, : places.shape[1]] = np.unpackbits(wide[real], axis=1, bitorder="little")[:, places]
                value = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0].astype(np.int64)
                key, i = (value * len(places) + np.arange(len(places))[None, :]).ravel(), np.repeat(real, len(places))
                some = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
                # keys of shingles are negative
                key, i = np.r_[key, np.concatenate(some) | np.int64(-1 << 63)], np.r_[i, np.repeat(np.arange(len(some)), [len(x) for x in some])]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[i]), *(pa.array(part[i, k]) for k in range(CHECKED))], names=["key", "node", *parts_of])

    columns = ", ".join(f"{k} long" for k in parts_of)
    rows = own.select("wide", "node", "size", "some").mapInArrow(c.tidy(blocks), f"key long, node long, {columns}")
    rows = rows.repartition(n, "key").sortWithinPartitions("key", "node")

    def compare(batches):
        """(0, a, b, -) for links, (1, key, node, fingerprint) for members of runs that are too long."""

        def links(a, b):
            e = pa.array(np.zeros(len(a), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a)), pa.int32()), pa.array(a), pa.array(b), *([e] * CHECKED)], names=["kind", "a", "b", *parts_of])

        def settle(key, node, fp, long_run):
            i, j = near_links(key, fp, np.where(key < 0, short_most, most))
            if len(i):
                yield links(*np.unique(np.stack([node[i], node[j]]), axis=1))
            if long_run:
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(key)), pa.int32()), pa.array(key), pa.array(node), *(pa.array(fp[:, k].view(np.int64)) for k in range(CHECKED))], names=["kind", "a", "b", *parts_of])

        kept, first = None, None  # the run that may go on in the next batch; the first member of a run that is too long
        for batch in batches:
            cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.stack([batch.column(2 + i).to_numpy() for i in range(CHECKED)], axis=1).view(_U64)]
            if not len(cols[0]):
                continue
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            at = 0
            if first is not None and cols[0][0] == first[0][0]:  # stretches of a long run, each with the run's first member
                end = int(np.searchsorted(cols[0], first[0][0], side="right"))
                while end - at > run_limit or (end < len(cols[0]) and at < end):
                    k = min(run_limit, end - at)
                    yield from settle(*(np.concatenate([f, x[at : at + k]]) for f, x in zip(first, cols, strict=True)), True)
                    at += k
                if end < len(cols[0]):
                    first = None
            cols = [x[at:] for x in cols]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            yield from settled(settle, cut, cols, run_limit)
            kept = [x[cut:] for x in cols]
            if first is None and len(kept[0]) > run_limit:
                first = [x[:1] for x in kept]
                yield from settle(*(x[:run_limit] for x in kept), True)
                kept = [x[run_limit:] for x in kept]
        if kept is not None and len(kept[0]):
            if first is not None and kept[0][0] == first[0][0]:
                kept = [np.concatenate(x) for x in zip(first, kept, strict=True)]
                yield from settle(*kept, True)
            else:
                yield from settled(settle, len(kept[0]), kept, run_limit)

    found = c.checkpoint(rows.mapInArrow(c.tidy(compare), f"kind int, a long, b long, {columns}"))
    pairs = c.checkpoint(found.filter("kind = 0").select("a", "b").distinct())
    long_runs = found.filter("kind = 1").select(F.col("a").alias("whole"), F.col("b").alias("node"), *parts_of).distinct()
    any_long = not long_runs.isEmpty()

    def sets(batches):
        for batch in batches:
            grams = [h.astype(np.uint32) for h in _sets(batch.column(1), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(g).tobytes() for g in grams], pa.binary())], names=["node", "grams"])

    def sets_of(nodes: DataFrame) -> DataFrame:
        return c.text_rows(docs, text, doc_id).join(nodes.select(F.col("node").alias("doc_id")), "doc_id").select("doc_id", "body").mapInArrow(c.tidy(sets), "node long, grams binary")

    def compare_sets(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer() or b"", np.uint32) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    paired = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    grams = c.checkpoint(sets_of(paired))
    both = pairs.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    links = c.checkpoint(both.select("a", "b", "ga", "gb").mapInArrow(c.tidy(compare_sets), "a long, b long"))
    named = paired.union(long_runs.select("node")).distinct() if any_long else paired
    parts = components(links).withColumnRenamed("root", "part")
    parts = c.checkpoint(named.join(parts, "node", "left").select("node", F.coalesce("part", "node").alias("part")))

    # groups joined by near fingerprints that the links found so far leave in several parts
    between = pairs.join(parts.select(F.col("node").alias("a"), F.col("part").alias("pa")), "a").join(parts.select(F.col("node").alias("b"), F.col("part").alias("pb")), "b")
    between = between.filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
    if any_long:

        def near_parts(batches):
            for key, side, part, values in _tiles(batches):
                fp = np.stack(values, axis=1).view(_U64)
                limit = short_most if key[0] < 0 else most
                yield from _part_links(*joined_parts(part, side, lambda x, y, fp=fp, limit=limit: np.bitwise_count(fp[y] ^ fp[x]).sum(axis=1) <= limit))

        dealt = tiles(long_runs.join(parts, "node").withColumn("weight", F.lit(1)), run_limit, n, *parts_of)
        between = between.union(dealt.mapInArrow(c.tidy(near_parts), "a long, b long")).distinct()
    broken = components(between).select(F.col("node").alias("part"), F.col("root").alias("whole"))
    open_ = c.checkpoint(parts.join(broken, "part").select("whole", "part", "node"))
    members = open_.join(sets_of(open_.select("node").distinct()) if any_long else grams, "node").withColumn("weight", F.octet_length("grams") / 4)

    def join_parts(batches):
        for _, side, part, (sets_,) in _tiles(batches):
            yield from _part_links(*linked_parts(part, side, [np.frombuffer(g, np.uint32) for g in sets_], similarity))

    joined = c.checkpoint(tiles(members, STRETCH, n, "grams").mapInArrow(c.tidy(join_parts), "a long, b long"))
    joined = components(joined).select(F.col("node").alias("part"), "root")
    roots = parts.join(joined, "part", "left").select("node", F.coalesce("root", "part").alias("component_id"))
    classes = own.join(roots, "node", "left").select("wide", F.coalesce("component_id", "node").alias("component_id"))
    return fps.join(classes, "wide", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def settled(settle, cut: int, cols: list[np.ndarray], run_limit: int):
    """Whole runs of a sorted stretch, of which those that are too long come by themselves."""
    key = cols[0][:cut]
    if not cut:
        return
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[starts, cut])
    good = np.repeat(size <= run_limit, size)
    if good.any():
        yield from settle(*(x[:cut][good] for x in cols), False)
    for s, k in zip(starts[size > run_limit].tolist(), size[size > run_limit].tolist(), strict=True):
        for at in range(0, k, run_limit):
            yield from settle(*(np.concatenate([x[s : s + 1], x[max(s + at, s + 1) : min(s + at + run_limit, s + k)]]) for x in cols), True)


def near_links(key: np.ndarray, fp: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) within the runs of equal keys that join whatever differs by ``most`` bits (for each place) or less: a place's first near one, and one for each group that it brings together."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[starts, len(key)])
    a, b = [], []
    few = np.repeat(size <= _SHIFTS, size)
    for d in range(1, int(size[size <= _SHIFTS].max(initial=1))):
        i = np.flatnonzero((key[:-d] == key[d:]) & few[:-d])
        near = np.bitwise_count(fp[i] ^ fp[i + d]).sum(axis=1) <= most[i]
        a.append(i[near])
        b.append(i[near] + d)
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    order = np.lexsort((i, j))
    i, j = i[order], j[order]
    # a place with one near one before it needs no search; others keep what brings groups together
    lead: dict[int, int] = {}
    keep = np.ones(len(i), bool)
    run = np.searchsorted(starts, i, side="right")
    many = np.flatnonzero(np.bincount(run, minlength=len(starts) + 1)[run] > 2)
    for k in many.tolist():
        x, y = _lead(lead, int(i[k])), _lead(lead, int(j[k]))
        if x == y:
            keep[k] = False
        else:
            lead[y] = x
    a, b = [i[keep]], [j[keep]]
    for s, k in zip(starts[size > _SHIFTS].tolist(), size[size > _SHIFTS].tolist(), strict=True):
        x, y = _tree(fp[s : s + k], int(most[s]))
        a.append(s + x)
        b.append(s + y)
    return np.concatenate(a), np.concatenate(b)


def _lead(lead: dict[int, int], x: int) -> int:
    while x in lead:
        x = lead[x]
    return x


def _tree(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """near_links() of one run."""
    k, a, b = len(fp), [], []
    label = np.arange(k)
    for at in range(0, k, 64):
        mine = fp[at : at + 64]
        end = at + len(mine)
        away = np.zeros((len(mine), end), np.uint16)
        for w in range(fp.shape[1]):
            away += np.bitwise_count(mine[:, w, None] ^ fp[None, :end, w])
        near = (away <= most) & (np.arange(end)[None, :] < np.arange(at, end)[:, None])
        for y in np.flatnonzero(near.any(axis=1)).tolist():
            before = np.flatnonzero(near[y])
            own = label[before]
            label[at + y] = own[0]
            a.append(before[:1])
            if (own != own[0]).any():
                groups, first = np.unique(own, return_index=True)
                a[-1] = before[np.sort(first)]
                label[:end][np.isin(label[:end], groups)] = own[0]
            b.append(np.full(len(a[-1]), at + y))
    e = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (e, e)


def tiles(rows: DataFrame, limit: int, n: int, *payload: str) -> DataFrame:
    """(whole, i, j, side, part, payload), sorted: the members of groups (whole, node, part, weight, payload) in tiles of two stretches, so that each two of different parts meet.

    A stretch weighs about ``limit``.  The largest part of a group has stretches of its own, which meet the others' but
    not each other.  side: 0 and 1 for the two stretches, 2 in a tile of one.
    """
    each = rows.groupBy("whole", "part").agg(F.sum("weight").alias("w"))
    sizes = each.groupBy("whole").agg(F.max_by("part", F.struct("w", "part")).alias("main"), F.max("w").alias("big"), F.sum("w").alias("all")).filter("`all` > big")
    sizes = sizes.select("whole", "main", F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("big")) / limit)).cast("int").alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("big") / limit)).cast("int").alias("big"))
    own = rows.join(sizes, "whole")
    lot = F.xxhash64("node", F.lit(5))
    big = F.col("part") == F.col("main")
    own = own.select("whole", "node", "part", *payload, "rest", "big", F.when(big, F.col("rest") + F.pmod(lot, F.col("big"))).otherwise(F.pmod(lot, F.col("rest"))).cast("int").alias("s"))
    own = own.select("whole", "node", "part", *payload, "s", F.explode(F.sequence(F.lit(0), F.when(F.col("s") >= F.col("rest"), F.col("rest")).otherwise(F.col("rest") + F.col("big")) - 1)).alias("t"))
    side = F.when(F.col("s") == F.col("t"), 2).when(F.col("s") < F.col("t"), 0).otherwise(1)
    own = own.select("whole", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), side.alias("side"), "part", "node", *payload)
    return own.repartition(n, "whole", "i", "j").sortWithinPartitions("whole", "i", "j", "part", "node").select("whole", "i", "j", "side", "part", *payload)


def _tiles(batches):
    """(key, sides, parts, payload columns) of each tile in sorted rows of tiles()."""
    key, held = None, []
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if not len(batch):
            continue
        edges = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in cols[:3]], axis=0), True])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = tuple(int(x[a]) for x in cols[:3])
            if own != key and held:
                yield key, *_joined(held)
                held = []
            key = own
            held.append([x[a:b] for x in cols[3:]])
    if held:
        yield key, *_joined(held)


def _joined(held: list[list[np.ndarray]]):
    side, part, *values = (np.concatenate(x) for x in zip(*held, strict=True))
    return side, part, values


def _part_links(a: list[int], b: list[int]):
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def joined_parts(part: np.ndarray, side: np.ndarray, near) -> tuple[list[int], list[int]]:
    """Links between the parts of a tile's members that join whatever is near; near(x, places) tells which places are near x."""
    _, label = np.unique(part, return_inverse=True)
    second, a, b = np.flatnonzero(side != 0), [], []
    for x in np.flatnonzero(side != 1).tolist():
        others = second[label[second] != label[x]]
        if len(others):
            found = others[near(x, others)]
            groups, first = np.unique(label[found], return_index=True)
            a += [int(part[x])] * len(groups)
            b += part[found[first]].tolist()
            if len(groups):
                label[np.isin(label, groups)] = label[x]
    return a, b


def linked_parts(part: np.ndarray, side: np.ndarray, grams: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """joined_parts() by the exact similarity of sets, through an index of the elements of the second stretch."""
    size = np.array([len(g) for g in grams])
    second = np.flatnonzero(side != 0)
    element = np.concatenate([grams[i] for i in second]) if len(second) else np.zeros(0, np.uint32)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], np.repeat(second, size[second])[order]

    def near(x: int, others: np.ndarray) -> np.ndarray:
        lo = np.searchsorted(element, grams[x])
        held = owner[c.ranges(lo, np.searchsorted(element, grams[x], side="right") - lo)]
        common = np.bincount(held, minlength=len(part))[others]
        return (common > 0) & (common >= similarity * (size[others] + size[x] - common))

    return joined_parts(part, side, near)
