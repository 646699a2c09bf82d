"""Suffix-array, SimHash and substring dedup against plain versions, on small awkward tables."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import _common as c
from gridloom.llm import queries as q
from gridloom.llm.components import components
from gridloom.llm.simhash import fingerprint_links, linked, near_duplicates, signed, simhash_near_duplicates
from gridloom.llm.substring_dedup import runs_of, substring_dedup, without
from gridloom.llm.suffix_dedup import shared_contexts, suffix_classes, suffix_dedup

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("body", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("score", T.DoubleType())])


def awkward(seed=0, n=60):
    """Documents with nulls, empty and very long texts, ties, repeats, copies, shared passages, and clashing columns."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeiou étx") for _ in range(rng.randint(1, 7))).strip() or "z" for _ in range(200)]

    def prose(k):
        return "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t ", "  "]) for _ in range(k))

    shared = [prose(30) for _ in range(3)]
    texts = [prose(rng.randint(0, 120)) + rng.choice(shared + [""] * 3) + prose(rng.randint(0, 40)) for _ in range(n)]
    texts += [None, "", " \n\t", "word", "x" * 5000, "ab " * 3000, "ab " * 2999, texts[3], texts[3], texts[5] + " tail", "é     wide spaces are words " * 8, "\x1f\x85" * 60]
    rows = [(i, t, "clash", 1, 0.5) for i, t in enumerate(texts)]
    rows += [(7, texts[7], "again", 2, None), (7, texts[9], "other text, same id", 2, None), (None, texts[11], None, None, None), (-5, texts[13], None, None, None)]
    rng.shuffle(rows)
    return rows


def cut_words(rows, window):
    first: dict[tuple, float] = {}
    own = [((float("inf") if r[0] is None else r[0]), (r[1] or "").encode().split()) for r in rows]
    for i, w in own:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, float("inf")), i)
    out = []
    for (i, w), r in zip(own, rows, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cut_bytes(rows, length):
    first: dict[bytes, float] = {}
    own = [((float("inf") if r[0] is None else r[0]), (r[1] or "").encode()) for r in rows]
    for i, b in own:
        for k in range(len(b) - length + 1):
            g = b[k : k + length]
            first[g] = min(first.get(g, float("inf")), i)
    out = []
    for (i, b), r in zip(own, rows, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int(np.diff(np.r_[False, gone].astype(int)).clip(0).sum())
        out.append((r[0], len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [5, 13])
def test_substring_dedup(spark, window):
    rows = awkward()
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA), window)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == cut_words(rows, window)
    for r in got.collect():
        assert r.n_removed == sum(s.end - s.start for s in r.removed) and r.left.split() == r.kept.split()


def test_runs_of():
    rng = np.random.default_rng(11)
    for kinds in (1, 3):
        key, check = rng.integers(0, 40, 300, dtype=np.uint64), rng.integers(0, kinds, 300).astype(np.uint16)
        order, starts = runs_of(key, check)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), 300], strict=True):
            assert len({(key[i], check[i]) for i in order[a:b]}) == 1
        assert len(starts) == len(set(zip(key.tolist(), check.tolist(), strict=True)))


def test_suffix_dedup(spark):
    rows = awkward(1)
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == cut_bytes(rows, 50)
    with pytest.raises(ValueError):
        suffix_dedup(spark.createDataFrame(rows, SCHEMA), 10)


def test_small_flushes(spark, monkeypatch):
    """What one flush can't settle is settled between flushes, and hot passages too."""
    monkeypatch.setattr(c, "FLUSH_BYTES", 700)
    monkeypatch.setattr("gridloom.llm.suffix_dedup.SORT_BYTES", 300)
    passage = " ".join(f"hot{i}" for i in range(40))
    rows = [(i, f"own{i} " * (i % 30) + passage + f" end{i}", None, None, None) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, substring_dedup(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == cut_words(rows, 13)
    assert sorted(map(tuple, suffix_dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == cut_bytes(rows, 50)


def test_hot_key_is_split(spark, monkeypatch):
    """One passage in random surroundings: many contexts of one key, which go apart and still meet window by window."""
    rng = np.random.default_rng(9)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)

    def text(k):
        return letters[rng.integers(0, 27, k)].tobytes().decode()

    passage = text(60)
    rows = [(i, text(int(rng.integers(60, 200))) + passage + text(int(rng.integers(60, 200))), None, None, None) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    heaviest = {}
    for least in (10**9, 100):
        monkeypatch.setattr("gridloom.llm.suffix_dedup.HOT_SAMPLE", 1)
        monkeypatch.setattr("gridloom.llm.suffix_dedup.HOT_DOCS", least)
        got = suffix_dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert sorted(map(tuple, got.collect()), key=str) == cut_bytes(rows, 50)
        loads = [r.b for r in shared_contexts(c.text_rows(df), 50).filter("kind = 0").groupBy("part").agg(F.sum(F.octet_length("payload")).alias("b")).collect()]
        heaviest[least] = max(loads) / sum(loads)
    assert heaviest[10**9] > 0.5 and heaviest[100] < 0.4


@given(st.binary(max_size=400).map(lambda b: bytes(x % 3 for x in b)), st.integers(50, 72))
@settings(max_examples=60, deadline=None)
def test_suffix_order(text, length):
    data = np.frombuffer(text + text[:150] + text[40:], np.uint8)
    n = len(data) - length + 1
    if n < 1:
        return
    starts = np.arange(n)
    order, klass = suffix_classes(data, starts, length)
    raw = data.tobytes()
    keys = [raw[i : i + length] for i in starts[order].tolist()]
    assert keys == sorted(keys)
    assert [k == j for k, j in zip(keys, keys[1:], strict=False)] == [a == b for a, b in zip(klass[:-1].tolist(), klass[1:].tolist(), strict=True)]


def test_without():
    assert without(b"a  b\nc d ", np.array([False, True, True, False])) == b"a  d "
    assert without(b" a b", np.array([True, True])) == b" "


def plain_fingerprint(text, size=3):
    w = (text or "").encode().lower().split()
    g = [b" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, most):
    """The smallest reachable of each place."""
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = root[i], root[j]
                if a != b:
                    root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_simhash(spark):
    rows = [*awkward(2), (None, "no other row is like this one", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fingerprint", F.lit("clash")).withColumn("component_id", F.lit(-5))
    got = simhash_near_duplicates(df, shingle=3).collect()
    fps = [plain_fingerprint(r[1]) for r in rows]
    root = plain_components(fps, 3)
    least: dict[int, int] = {}
    for r, k in zip(rows, root, strict=True):
        if r[0] is not None:  # a row without doc_id is never a component_id
            least[k] = min(least.get(k, r[0]), r[0])
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], f"{f:016x}", least.get(k))) for r, f, k in zip(rows, fps, root, strict=True))
    assert simhash_near_duplicates(df.filter("false")).count() == 0


def test_native_hash_agrees(spark):
    texts = ["a b c", "é ü 日本", "", "x" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()
    assert [r[0] for r in df] == [signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in texts]


@pytest.mark.parametrize("limit", [4096, 5])
def test_links_between_close_fingerprints(spark, limit):
    """A dense ball and scattered fingerprints; with a small limit long runs are split in further rounds."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(60):
        x = rng.choice(sorted(fps)[:10])
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(40)}
    fps = sorted(fps)
    links = fingerprint_links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), 3, limit)
    pairs = [(r.a & 2**64 - 1, r.b & 2**64 - 1) for r in links.collect()]
    want = plain_components(fps, 3)
    at = {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))
    for a, b in pairs:
        x, y = root[at[a]], root[at[b]]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert root == want


def test_linked_is_exact():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1, dtype=np.uint64)
    fps = base ^ (np.uint64(1) << rng.integers(0, 12, (80, 3)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    own = np.unique(fps)
    want = plain_components([int(x) for x in own], 2)
    root, at = list(range(len(own))), {int(f): i for i, f in enumerate(own)}
    for a, b in linked(fps, 2):
        x, y = root[at[a]], root[at[b]]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert root == want


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
@settings(max_examples=8, deadline=None)
def test_components(spark, links):
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for p in links for x in p}
    for a, b in links * len(links):
        root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in links)}


def test_near_duplicates(spark):
    rng = random.Random(9)
    rows, truth = [], {}
    for g in range(20):
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        for k in range(4):
            own = list(words)
            for _ in range(3 * (k > 0)):
                own[rng.randrange(200)] = f"edit{rng.randrange(10**6)}"
            truth[len(rows)] = g * 4
            rows.append((len(rows), " ".join(own), None, None, None))
    for _ in range(60):
        truth[len(rows)] = len(rows)
        rows.append((len(rows), " ".join(f"w{rng.randrange(3000)}" for _ in range(150)), None, None, None))
    rows += [(None, rows[0][1], None, None, None), (500, None, None, None, None), (501, "", None, None, None)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    wrong = [i for i, t in truth.items() if got[i] != t]
    assert len(wrong) <= 2 and got[None] is None


@pytest.mark.parametrize("run", [substring_dedup, suffix_dedup, simhash_near_duplicates, near_duplicates])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_queries_agree_with_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    for name, sql in q.ORACLE.items():
        a, b = q.QUERIES[name](spark, d).toPandas(), con.sql(sql).df()
        cols = sorted(a.columns)
        assert sorted(a[cols].astype(str).itertuples(index=False, name=None)) == sorted(b[cols].astype(str).itertuples(index=False, name=None)), name
