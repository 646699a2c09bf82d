"""Neighbours, URL filter, personal data, packing, toxicity, media and BPE against plain versions."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import media, neighbours, packing, pii, toxicity, url_filter
from gridloom.llm.byte_bpe import BytePairEncoder, PerfectHash, encode_decode
from gridloom.llm.queries import URL_RULES
from tests.llm.test_dedup import SCHEMA, awkward

# -- neighbours ---------------------------------------------------------------------------------


def exact(rows, asked, k):
    out = {}
    own = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    for q, v in own:
        if asked(q):
            best = sorted((-float(w @ v), i) for i, w in own if i != q)[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def test_neighbours_small(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # copies: ties go to the smaller id
    bad = [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [float("inf")] + [1.0] * 7), (904, [1.0, None] + [1.0] * 6), (905, [1.0] * 3), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows + bad], "vec_id long, embedding array<float>, score double").repartition(7)
    got: dict = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 5 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = exact(rows, lambda q: q % 5 == 0, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_neighbours_fewer_than_k(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") == 0, k=20).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 1), (2, 2)]
    assert neighbours.nearest(df.filter("false"), F.col("vec_id") == 0).count() == 0


def test_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.standard_normal((2500, 32)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(rows, lambda q: q % 50 == 0, 20)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


# -- URL filter ---------------------------------------------------------------------------------


def test_urls(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/1?x#y", "https://www.example.com/en/2", "http://a.example.com", "http://x.net/es/1", "http://x.net/fr/", "http://x.net/en/", "x://h#a/b", "a://b://c/d", "http://net/es/", "http://É.com/Ä", "http://h/" + "y" * 5000]
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(1, "", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, template string")
    got = {r.page_id: r for r in url_filter.url_filter(df, URL_RULES).collect()}
    assert url_filter.url_filter(df, URL_RULES).count() == len(rows)

    def plain(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(x.lower() if "A" <= x <= "Z" else x for x in host)
        fit = [(len(h + p), h + p, kind) for kind, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == plain(u), u
    assert url_filter.url_filter(df.filter("false"), URL_RULES).count() == 0


def test_templates_learn(spark):
    rows = [(f"http://h.org/{kind}/{i}/x{i}", int(kind == "bad") if i % 2 else None) for kind in ("bad", "good") for i in range(100)]
    df = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id long, url string, y int")
    got = url_filter.url_filter(df, label=F.col("y"))
    assert {(r.path.split("/")[1], r.verdict) for r in got.collect()} == {("bad", "block"), ("good", "allow")}
    assert got.select("template").distinct().count() == 2
    alike = url_filter.url_filter(df.withColumn("url", F.regexp_replace("url", "/(bad|good)/", "/$1/")), label=F.lit(0))
    assert alike.select("template").distinct().count() == 1  # branches that don't differ merge


def test_deep_branches_have_verdicts_of_their_own(spark):
    """Paths of ten segments whose eighth tells bad from good, and one of hundreds that no other shares."""
    rows = [(f"http://h.org/a/b/c/d/e/f/g/{kind}/i/j{i}", int(kind == "bad") if i % 2 else None) for kind in ("bad", "good") for i in range(60)]
    rows.append(("http://h.org" + "/a" * 7 + "/x" * 300, None))
    got = url_filter.url_filter(spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id long, url string, y int"), label=F.col("y")).collect()
    assert len(got) == len(rows)
    assert {(r.path.split("/")[8], r.verdict) for r in got[:] if len(r.path) < 100} == {("bad", "block"), ("good", "allow")}
    long = next(r for r in got if len(r.path) > 100)
    assert long.template.count("/") == long.path.count("/") and long.verdict == "allow"


# -- personal data ------------------------------------------------------------------------------


def plain_spans(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@given(st.text(alphabet="a1.@+- ()9é%2\n", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_long():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "a@" * 50_000, "4" * 16 + " " + "a.b@c.de " * 20_000):
        assert len(pii.base_spans(text)) >= 0


def scored(field, sequences):
    words = [w for s in sequences for w in s]
    starts = np.cumsum([0, *(len(s) for s in sequences)])[:-1]
    hashes = np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], np.uint64)
    return field.emissions(hashes, lambda i: words[i], starts), starts


def decoded(field, sequences):
    tags = [field.tags[t] for t in field.decode(*scored(field, sequences))]
    cuts = np.cumsum([0, *(len(s) for s in sequences)]).tolist()
    return [tags[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def test_field_on_unseen_examples():
    field, table = pii.default_field(), pii.labelled_table(300, seed=99)
    tags = decoded(field, [w for w, _ in table])
    assert np.mean([a == b for t, (_, g) in zip(tags, table, strict=True) for a, b in zip(t, g, strict=True)]) > 0.97
    again = pii.Field().train(pii.labelled_table())
    assert np.array_equal(again.weight, field.weight)


def test_viterbi_is_best():
    field = pii.default_field()
    words = ["call", "+1", "(017)", "555-7713", "now"]
    (emit, _), trans = scored(field, [words]), field.trans
    names = [[*(f"c:{f}" for f in pii.features(w)), *([f"p:{f}" for f in pii.features(words[i - 1])] if i else ["p:^"]), *([f"n:{f}" for f in pii.features(words[i + 1])] if i + 1 < len(words) else ["n:$"])] for i, w in enumerate(words)]
    assert np.allclose(emit, [sum(field.weight[field.index[f]] for f in own if f in field.index) for own in names])
    k = len(field.tags)
    best = max(((sum(emit[i, t] for i, t in enumerate(p)) + trans[k, p[0]] + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False))), p) for p in np.ndindex(*(k,) * len(words)))[1]
    assert decoded(field, [words]) == [[field.tags[t] for t in best]]


def test_leaving_out_what_is_o_beyond_doubt_changes_nothing():
    field, rng = pii.default_field(), np.random.default_rng(10)
    found = 0
    for scale in (0.5, 2.0, 6.0):
        for _ in range(40):
            starts = np.cumsum([0, *rng.integers(1, 60, 8)])
            emit = rng.standard_normal((int(starts[-1]) + 30, len(field.tags))) * scale
            emit[:, 0] += rng.choice([0.0, 4.0, 14.0], len(emit))
            tags = field.decode(emit, starts)
            assert np.array_equal(tags, field.decode(emit, starts, sure=False))
            found += int((~field.doubtful(emit, starts)).sum())
    assert found > 500
    table = [w for w, _ in pii.labelled_table(200, seed=5)]
    emit, starts = scored(field, [[w for s in table[i : i + 20] for w in s] for i in range(0, 200, 20)])
    assert np.array_equal(field.decode(emit, starts), field.decode(emit, starts, sure=False))


@given(st.text(alphabet="aZé9_-.(@+~#\u00b2", max_size=30))
@settings(max_examples=300, deadline=None)
def test_shape(token):
    core = token.strip(pii._EDGE) or token[:1]
    kinds = ["9" if x in "0123456789" else ("A" if x.isupper() else "a") if re.fullmatch(r"[^\W\d_]", x) else x for x in core]
    runs = "".join(x for i, x in enumerate(kinds) if not i or kinds[i - 1] != x)
    assert pii.shape(token) == (runs if len(runs) <= 24 else "~")
    assert f"s:{pii.shape(token)}" in pii.features(token) or not token.strip(pii._EDGE)


def test_pii(spark):
    texts = [None, "", "clean words only", "mail a.b@c.de and 1.2.3.4, card 4111 1111 1111 1111; call +1 (017) 555-7713!", "token = \"" + "0a1b" * 10 + "\" é a@b.cc", "x" * 100_000 + " 1.2.3.4", "(017) 555-7713 here"]
    rows = [(i, t, "clash", 1, 0.5) for i, t in enumerate(texts)] + [(3, texts[3], None, None, None), (None, texts[3], None, None, None)]
    got = pii.pii(spark.createDataFrame(rows, SCHEMA), with_row=True).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r.row.text or ""
        base = plain_spans(t)
        assert r.base == pii.listed(base) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == b[2] for b in base) for k in pii.BASE_KINDS]
        assert set(r.base.split(",")) <= set(r.spans.split(",")) | {""}
        if "@" not in t and not any(x.isdigit() for x in t):
            assert r.spans == "" and r.redacted == t
    row = next(r for r in got if r.doc_id == 3)
    assert row.redacted == "mail <email> and <ip>, card <card>; call <phone>!"
    assert "secret" in next(r for r in got if r.doc_id == 4).spans and "phone" in next(r for r in got if r.doc_id == 6).spans
    assert pii.pii(spark.createDataFrame([], SCHEMA)).count() == 0


# -- packing ------------------------------------------------------------------------------------


@given(st.lists(st.tuples(st.integers(0, 40), st.sampled_from("aaabcd"), st.sampled_from([1, 1, 2, 3, None])), max_size=80), st.integers(40, 60))
@settings(max_examples=150, deadline=None)
def test_tightest_bin(items, capacity):
    packed, bins = packing.BestFit(capacity), {}
    for size, source, cluster in sorted(items, key=lambda x: -x[0]):
        fits = [b["room"] for b in bins.values() if b["room"] >= size and source not in b["s"] and (cluster is None or cluster not in b["c"])]
        number, offset = packed.put(size, source, cluster)
        own = bins.setdefault(number, {"room": capacity, "s": set(), "c": set()})
        assert own["room"] == (min(fits) if fits else capacity) and offset == capacity - own["room"]
        assert source not in own["s"] and (cluster is None or cluster not in own["c"])
        own["room"] -= size
        own["s"].add(source)
        own["c"] |= {cluster} - {None}


def test_best_fit(spark):
    rows = [(i, " ".join(["w"] * n), None, None, None) for i, n in enumerate([0, 1, 99, 100, 101, 350, 7, 7])] + [(3, None, None, None, None), (None, "a b", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "hot"))
    got = packing.best_fit(df, capacity=100, shard_items=4).collect()
    sizes: dict = {}
    for r in got:
        sizes.setdefault(r.doc_id, []).append(r.size)
        assert r.start == 100 * r.piece and 0 <= r.offset <= 100 - r.size
    assert {k: sum(v) for k, v in sizes.items()} == {0: 0, 1: 1, 2: 99, 3: 100, 4: 101, 5: 350, 6: 7, 7: 7, None: 2}
    for b in {r.bin for r in got}:
        own = sorted((r.offset, r.size) for r in got if r.bin == b)
        assert all(a + s <= c for (a, s), (c, _) in zip(own, own[1:], strict=False))
    assert packing.best_fit(df.filter("false")).count() == 0


# -- toxicity -----------------------------------------------------------------------------------


def tables(spark, n=400):
    rng = random.Random(1)
    vocabulary = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}" for i in range(500)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        bad = i % 5 == 0
        for _ in range(5 * bad):
            words[rng.randrange(len(words))] = rng.choice(["vile", "Foul!", "nasty"])
        docs.append((i, " ".join(words), "clash", 1, 0.5))
        if i % 4:
            labels.append((i, int(bad)))
    docs += [(n, None, None, None, None), (n + 1, "", None, None, None), (None, "vile foul nasty vile", None, None, None), (5, docs[5][1], None, None, None), (n + 2, "vile " * 30_000, None, None, None)]
    labels += [(None, 1), (n, None), (1, 0), (10**6, 1)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"), docs


def test_toxicity(spark):
    df, labels, docs = tables(spark)
    got = toxicity.toxicity(df, labels).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    unseen = [i for i in range(0, 400, 4)]
    assert np.mean([(by[i].score >= 0.3) == (i % 5 == 0) for i in unseen]) > 0.95
    assert by[400].score == by[401].score < 0.3 and by[None].score > 0.3 and by[0].evidence and not by[401].evidence


def test_toxicity_without_examples(spark):
    df, labels, docs = tables(spark, 30)
    for none in (labels.filter("false"), labels.filter("toxic = 0"), labels.filter("toxic = 1")):
        assert len({r.score for r in toxicity.toxicity(df, none).collect()}) == 1
    assert toxicity.toxicity(df.filter("false"), labels).count() == 0


def test_held_out(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", toxicity.held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


@pytest.mark.parametrize("width", [30, 400])
def test_nearest_is_exact(width):
    """With few words all are rows of the matrix, with many most are lists; documents also hold words that no example has."""
    rng = np.random.default_rng(8)
    words, weight = np.sort(rng.integers(1, 1 << 63, width, dtype=np.uint64)), rng.random(width) + 0.5
    examples = []
    for i in range(700):
        own = np.sort(rng.choice(width, rng.integers(0, 9), replace=False, p=np.arange(width, 0, -1) / (width * (width + 1) / 2)))
        examples.append((i, int(rng.integers(0, 2)), words[own], rng.integers(1, 5, len(own)).astype(np.uint32), words[own]))
    index = toxicity.ExampleIndex(examples, words, weight, 0.7, (1.0, 1.0), 15, 0.3)

    def dense(own, times):
        v = np.zeros(width)
        v[np.searchsorted(words, own)] = (1 + np.log(times)) * weight[np.searchsorted(words, own)]
        return v

    table = np.array([dense(e[2], e[3]) / max(1e-9, np.linalg.norm(dense(e[2], e[3]))) for e in examples])
    bodies = [np.repeat(e[2], e[3]) for e in examples[:200]]
    odd = [np.r_[b, np.full(i % 4, 5, np.uint64), np.full(i % 3, 9, np.uint64)] for i, b in enumerate(bodies)]
    found, score = index.nearest(index.documents(np.concatenate(odd), np.array([len(x) for x in odd])))
    for i in range(200):
        q = dense(examples[i][2], examples[i][3])
        more = sum(((1 + np.log(n)) * 0.7) ** 2 for n in (i % 4, i % 3) if n)
        sims = table @ (q / max(1e-9, np.sqrt(q @ q + more)))
        want = np.sort(sims)[::-1][:15]
        assert np.allclose(score[i], np.maximum(want, 0), atol=1e-9)
        assert all(np.isclose(sims[index.ids[f]], x, atol=1e-9) for f, x in zip(found[i], score[i], strict=True) if f >= 0)
        assert (found[i] >= 0).sum() == min(15, (sims > 1e-12).sum())


def test_every_document_that_shares_a_word_has_evidence(spark):
    df, labels, docs = tables(spark, 60)
    got = toxicity.toxicity(df, labels).collect()
    known = {r.doc_id for r in labels.collect()}
    held = {w for r in df.collect() if r.doc_id in known for w in re.findall("[a-z]+", (r.text or "").lower())}
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in got:
        shares = any(w in held for w in re.findall("[a-z]+", (texts[r.doc_id] or "").lower()))
        assert bool(r.evidence) == shares


def test_monotone():
    x, y = toxicity.monotone(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()


# -- media --------------------------------------------------------------------------------------


@given(st.lists(st.binary(max_size=300), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_media_round_trip(bodies):
    payloads = [b + bytes(-len(b) % 64 or (0 if b else 64)) for b in bodies]
    images = [media.parse(m) for m in media.store(payloads)]
    media.read([x for own in images for x in own])
    assert [own[0].thumbnail.tobytes() for own in images] == payloads


def test_media_several_images():
    payload = np.random.default_rng(1).integers(0, 256, 64 * 9000, dtype=np.uint8).tobytes()
    images = media.parse(media.store([payload])[0])
    media.read(images)
    assert len(images) == 2 and b"".join(x.thumbnail.tobytes() for x in images) == payload


class Bits:
    def __init__(self):
        self.bits = ""

    def put(self, code, n):
        self.bits += f"{code:0{n}b}" if n else ""

    def close(self):
        raw = bytes(int((self.bits + "1" * (-len(self.bits) % 8))[i : i + 8], 2) for i in range(0, len(self.bits), 8))
        return raw.replace(b"\xff", b"\xff\0")


def test_media_general_image():
    """4:2:0 colour with AC coefficients and long codes, and no restart markers, written here by a plain encoder."""
    rng = random.Random(3)
    dc = media.codes_of(media.DC_COUNTS, media.DC_SYMBOLS)
    ac_counts, ac_symbols = bytes([0, 1, 1, 1] + [0] * 11 + [2]), bytes([0x00, 0x01, 0xF0, 0x02, 0x53])
    ac = media.codes_of(ac_counts, ac_symbols)
    w = Bits()
    pred, luma = [0, 0, 0], {}
    for my in range(2):
        for mx in range(3):
            for comp, blocks in ((0, 4), (1, 1), (2, 1)):
                for b in range(blocks):
                    value = rng.randint(-100, 100)
                    d = value - pred[comp]
                    pred[comp] = value
                    size = abs(d).bit_length()
                    w.put(*dc[size])
                    w.put(d if d >= 0 else d + (1 << size) - 1, size)
                    if comp == 0:
                        luma[my * 2 + b // 2, mx * 2 + b % 2] = value
                    for symbol in rng.choice([[], [0x01], [0xF0, 0x02], [0x53, 0x01]]):
                        w.put(*ac[symbol])
                        w.put(rng.getrandbits(symbol & 15) if symbol & 15 else 0, symbol & 15)
                    w.put(*ac[0])

    def part(marker, body):
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    data = b"\xff\xd8" + part(0xE0, b"JFIF\0") + part(0xDB, b"\0" + bytes([16] * 64)) + part(0xC0, bytes([8, 0, 30, 0, 45, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    data += part(0xC4, b"\0" + media.DC_COUNTS + media.DC_SYMBOLS) + part(0xC4, b"\x10" + ac_counts + ac_symbols) + part(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + w.close() + b"\xff\xd9"
    image = media.parse(data)
    media.read(image)
    want = [[min(255, max(0, (luma[y, x] * 16 + 4 >> 3) + 128)) for x in range(6)] for y in range(4)]
    assert image[0].thumbnail.tolist() == want and (image[0].width, image[0].height) == (45, 30)


def test_media_query(spark):
    rows = awkward(4)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(media.media_digests(df).collect(), key=str)
    assert len(got) == len(rows)
    want: dict = {}
    for r in rows:
        b = (r[1] or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        want.setdefault(r[0], []).append((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in want[r.doc_id]
    bad = spark.createDataFrame([(1, b"junk"), (2, None), (3, b"\xff\xd8\xff"), (4, media.store([bytes(64)])[0])], "k long, media binary")
    assert {r.k: r.width for r in media.media_features(bad, "k").collect()} == {1: None, 2: None, 3: None, 4: 512}
    assert media.media_digests(df.filter("false")).count() == 0


# -- byte-level BPE -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return BytePairEncoder.load(vocabulary.path("byte_bpe_50k.tiktoken"), vocabulary.PATTERN)


@pytest.fixture(scope="module")
def reference(vocabulary):
    import tiktoken

    with open(vocabulary.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.lists(st.text(max_size=60), max_size=5))
@settings(max_examples=200, deadline=None)
def test_bpe(encoder, reference, texts):
    ids = encoder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [reference.encode_ordinary(t) for t in texts]
    assert [encoder.decode(x) for x in ids] == [t.encode() for t in texts]


def test_bpe_long(encoder, reference):
    for t in ("a" * 30_000, "<|endoftext|>", " \n\t " * 500, "antidisestablishmentarianism" * 50):
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == reference.encode_ordinary(t)


def test_bpe_operator(spark, reference, vocabulary):
    rows = awkward(5)
    got = encode_decode(spark.createDataFrame(rows, SCHEMA), vocabulary.path("byte_bpe_50k.tiktoken"), vocabulary.PATTERN).collect()
    want = sorted((str(r[0]), np.array(reference.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in rows)
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == want


@given(st.sets(st.binary(max_size=6), max_size=300))
@settings(max_examples=60, deadline=None)
def test_perfect_hash(keys):
    own = sorted(keys)
    h = PerfectHash(own, range(len(own)))
    assert sorted(h.slots(own).tolist()) == list(range(len(own)))
    assert h.find(own) == list(range(len(own))) and h.find([b"not in it"]) == [-1]
