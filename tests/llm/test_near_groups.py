"""Near-duplicate groups of the pipeline whose links are hard to find: loose groups, long runs of a block, short texts."""

import random

import numpy as np
import pytest

from gridloom.llm import simhash
from gridloom.llm.simhash import near_duplicates, shingle_hashes

SCHEMA = "doc_id long, text string"


def edited(words, rng, n, tag):
    out = list(words)
    for k, i in enumerate(rng.sample(range(len(words)), n)):
        out[i] = f"{tag}x{k}"
    return out


def groups(spark, texts, **more):
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    return {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), **more).collect()}


def test_edited_copies_of_a_late_original(spark):
    """Each copy is 0.85 like the original in the middle, about 0.73 like the others: one component."""
    rng = random.Random(1)
    first = [f"w{i}" for i in range(200)]
    texts = [first if i == 150 else edited(first, rng, 16, f"c{i}") for i in range(301)]
    got = groups(spark, texts, shingle=1)
    assert len(set(got.values())) == 1, len(set(got.values()))


def test_later_copy_of_a_member_of_a_long_run(spark, monkeypatch):
    """All agree in the first block alone; the last is near the second, which is near the first, in a run that comes in several batches."""
    rng = np.random.default_rng(2)
    flips = [0, 0b11, *(1 << 8 + k for k in range(6)), 0b11111]
    table, rows = {}, []
    for i, flip in enumerate(flips):
        bits = np.r_[np.full(1, 1), np.full(15, 0xFFFF ^ flip), rng.integers(1, 1 << 16, 48)].astype("<u2")
        own = 1 if i == len(flips) - 1 else i
        rows.append((i, f"mark{i} " + " ".join(f"t{own}w{k}" for k in range(50))))
        table[int(shingle_hashes(b"mark%d" % i, 1)[0])] = bits.tobytes()
    monkeypatch.setattr(simhash, "wide_fingerprint", lambda hashes: next(table[h] for h in hashes.tolist() if h in table))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=1, run_limit=4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc_id: r.component_id for r in got} == {i: 1 if i == len(flips) - 1 else i for i in range(len(flips))}


def test_short_texts(spark):
    """Texts of few shingles, each with a copy that has a word more or three."""
    rng = random.Random(3)
    texts = []
    for i in range(120):
        words = [f"t{i}w{k}" for k in range(8 if i < 60 else 16)]
        texts += [words, words + [f"more{rng.random()}" for _ in range(1 if i < 60 else 3)]]
    got = groups(spark, texts)
    lost = [i for i in range(0, len(texts), 2) if got[i] != i or got[i + 1] != i]
    assert not lost, len(lost)


def test_room_of_the_distance():
    """At least 3.5 standard errors above the expected distance, for whatever numbers of shingles at a similarity of 0.8."""
    assert abs(simhash.differing(4, 5, 4) - 0.1875) < 1e-12
    for m, n, common in [(4, 5, 4), (12, 15, 12), (13, 14, 12), (40, 41, 36), (100, 100, 89), (100, 125, 100)]:
        p = simhash.differing(m, n, common)
        least, most, slack = (1, 32, simhash.SLACK[1]) if m <= 32 else (33, 128, simhash.SLACK[0])
        assert simhash.farthest(0.8, least, most, slack) >= 256 * p + 3.5 * (256 * p * (1 - p)) ** 0.5


def exact_components(texts, size, similarity):
    sets = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return root


@pytest.mark.parametrize("run_limit", [4096, 32])
def test_groups_of_edited_copies(spark, run_limit):
    """Six groups of copies, two to five words of 200 edited in each: most pairs of a group are below the similarity; with short runs, every run of a group is too long to be held."""
    rng = random.Random(4)
    texts = []
    for g in range(6):
        first = [f"g{g}w{i}" for i in range(200)]
        texts += [edited(first, rng, rng.randint(2, 5), f"g{g}c{k}") for k in range(100)]
    rng.shuffle(texts)
    want, got = exact_components(texts, 5, 0.8), groups(spark, texts, run_limit=run_limit)
    assert sum(got[i] != want[i] for i in range(len(texts))) <= 2


def test_tree_and_tiles_join_all_that_is_near():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (12, 4), dtype=np.uint64)
    fp = base[rng.integers(0, 12, 400)] ^ (np.uint64(1) << rng.integers(0, 40, (400, 4), dtype=np.uint64))
    key = np.sort(rng.integers(0, 60, 400))
    for most in (2, 4, 6):
        i, j = simhash.near_links(key, fp, np.full(400, most))
        lead, want = {}, {}
        for x in range(400):
            for y in range(x):
                if key[x] == key[y] and np.bitwise_count(fp[x] ^ fp[y]).sum() <= most:
                    a, b = simhash._lead(want, x), simhash._lead(want, y)
                    if a != b:
                        want[max(a, b)] = min(a, b)
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            assert x < y and key[x] == key[y] and np.bitwise_count(fp[x] ^ fp[y]).sum() <= most
            a, b = simhash._lead(lead, x), simhash._lead(lead, y)
            assert a != b  # no link too many
            lead[max(a, b)] = min(a, b)
        assert [simhash._lead(lead, x) for x in range(400)] == [simhash._lead(want, x) for x in range(400)]


def test_members_of_different_parts_share_a_tile(spark):
    rows = [(w, n, 0 if n < 30 else n % 5, 1) for w, size in ((1, 60), (2, 7), (3, 40)) for n in range(size)] + [(4, n, 9, 1) for n in range(20)]
    got = simhash.tiles(spark.createDataFrame(rows, "whole long, node long, part long, weight long"), 8, 4, "node").collect()
    met = set()
    tiles: dict = {}
    for r in got:
        tiles.setdefault((r.whole, r.i, r.j), []).append(r)
    for (w, _, _), own in tiles.items():
        assert len(own) <= 40
        met |= {(w, x.node, y.node) for x in own for y in own if x.side != 1 and y.side != 0}
    for w, a, p, _ in rows:
        for v, b, q, _ in rows:
            if v == w and p != q:
                assert (w, a, b) in met or (w, b, a) in met
    assert not any(r.whole == 4 for r in got)


def test_blocks_widen_with_the_number_of_documents():
    rng = np.random.default_rng(6)
    p = simhash.angle_bits(0.8, 1 << 20) / (1 << 20)
    for count, width in ((0, 16), (1000, 16), (1 << 26, 16), (1 << 28, 20), (1 << 33, 24)):
        places = simhash.block_places(count, 0.8)
        assert places.shape[1] == width and all(len(set(b)) == width for b in places.tolist())
        met = np.mean([(rng.random(1024) < 1 - p)[places].all(axis=1).any() for _ in range(2000)])
        assert met > 0.985
    assert simhash.block_places(10, 0.8)[:, 0].tolist() == list(range(0, 1024, 16))
