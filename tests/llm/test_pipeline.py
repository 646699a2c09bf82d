"""The pipeline on small tables: each stage against a plain version, and what goes through untouched."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as p
from gridloom.llm import pii
from tests.llm.test_dedup import cut_words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, `no.te` array<string>"


def corpus(spark, tmp_path, n=160):
    rng = random.Random(6)
    passage = " ".join(f"pass{i}" for i in range(60))
    docs, labels, copies = [], [], {}
    for i in range(n):
        words = [f"w{rng.randrange(4000):04d}".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(rng.randint(60, 150))]
        if i % 6 == 0:
            for _ in range(8):
                words[rng.randrange(len(words))] = rng.choice(["vile", "foul", "nasty"])
            labels.append((i, 1))
        else:
            labels.append((i, 0))
        text = " ".join(words)
        if i % 10 == 1:
            text += "\n" + passage
        if i % 10 == 3:
            text += " write to a.b@c.de now"
        docs.append((i, text, "en", "hot" if i % 3 else f"s{i}", len(text), i / 7, [f"x{i}", None]))
    for k, i in enumerate(range(1, 40, 6)):
        words = docs[i][1].split(" ")
        words[5] = "changed"
        copies[n + k] = i
        docs.append((n + k, " ".join(words), None, None, None, None, None))
    docs += [(n + 50, None, None, None, None, None, None), (n + 51, "", "en", "x", 0, 0.0, []), (None, "no id", "en", "x", 5, float("inf"), ["", "é"])]
    spark.createDataFrame(docs, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(str(tmp_path / "labels.parquet"))
    return docs, copies


def test_stages(spark, tmp_path):
    docs, copies = corpus(spark, tmp_path)
    own = {d[0]: d for d in docs}
    df, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in p.STAGES:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in df.collect()} if name != "packing" else df.collect()
        if name != "packing":
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "no.te"]
    toxic = {d[0] for d in docs if d[0] is not None and d[0] < 160 and d[0] % 6 == 0}
    assert set(own) - set(seen["toxicity"]) == toxic
    assert all(tuple(r) == own[i] for i, r in seen["toxicity"].items())
    assert set(seen["toxicity"]) - set(seen["near_duplicate_removal"]) == {*copies, 211}  # of the null and the empty text one stays
    before = [tuple(r)[:5] for r in seen["near_duplicate_removal"].values()]
    kept = {i: sha for i, _, _, sha in cut_words(before, 13)}
    import hashlib

    for i, r in seen["repeated_passages"].items():
        assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == kept[i]
        if (r.text or "").split() == (own[i][1] or "").split():
            assert tuple(r) == own[i]
        else:
            assert r.n_chars == len(r.text)
    for i, r in seen["personal_data"].items():
        text = seen["repeated_passages"][i].text
        spans = pii.find_spans([text or ""], pii.default_field())[0][1]
        assert r.text == (pii.redact(text, spans) if spans else text)
    sizes: dict = {}
    for r in seen["packing"]:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.size
    assert sizes == {i: len((r.text or "").split()) for i, r in seen["personal_data"].items()}
    run = sorted(map(str, p.run(spark, str(tmp_path)).collect()))
    assert run == sorted(map(str, seen["packing"]))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
