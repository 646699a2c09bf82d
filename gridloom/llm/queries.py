"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.byte_bpe import encode_digests
from gridloom.llm.media import media_digests
from gridloom.llm.neighbours import nearest
from gridloom.llm.packing import best_fit
from gridloom.llm.pii import pii
from gridloom.llm.simhash import simhash_near_duplicates
from gridloom.llm.substring_dedup import substring_dedup
from gridloom.llm.suffix_dedup import suffix_dedup
from gridloom.llm.toxicity import held_out, teaching, toxicity
from gridloom.llm.url_filter import BAD_HOST_WORDS, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), length=50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=3)


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The rules of the query.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op5_url_template_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"), capacity=2048)


def op8_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), teaching(table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_simhash_near_dup": op2_simhash_near_dup,
    "op3_nn_descent": op3_nn_descent,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_url_template_filter": op5_url_template_filter,
    "op6_pii_crf": op6_pii_crf,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_toxicity_knn": op8_toxicity_knn,
    "op9_media_jpeg": op9_media_jpeg,
    "op10_byte_bpe": op10_byte_bpe,
}

_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"



def _url_sql(depth: int = 8) -> str:
    """The tree of paths of up to ``depth`` segments (those of pages have 3 at most; the operator goes as deep as paths do)."""
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, kind) for kind, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits) + " END"
    by_rule = "CASE " + " ".join(f"WHEN {f} THEN '{k}'" for f, _, k in fits) + " END"
    words = ", ".join(f"'{w}'" for w in BAD_HOST_WORDS)
    sql = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
 p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
 r AS (SELECT *, {rule} AS rule, {by_rule} AS by_rule, regexp_replace(regexp_replace(regexp_replace(path, '[0-9a-f]{{16,}}', '#', 'g'), '[0-9]+', '#', 'g'), '[^/]{{33,}}', '~', 'g') AS form FROM p),
 l AS (SELECT *, CASE WHEN by_rule = 'block' THEN 1 WHEN by_rule = 'allow' THEN 0 WHEN list_has_any(regexp_split_to_array(host, '[.-]'), [{words}]) THEN 1 END AS label FROM r),
 t0 AS (SELECT host, form, '' AS template, string_split(form, '/') AS segs, count(*) AS pages, count(label) AS labelled, coalesce(sum(label), 0) AS bad FROM l GROUP BY host, form)"""
    for k in range(1, depth + 1):
        sql += f""",
 s{k} AS (SELECT *, CASE WHEN len(segs) > {k} THEN segs[{k + 1}] END AS seg FROM t{k - 1}),
 n{k} AS (SELECT host, template, seg, sum(pages) AS n, sum(labelled) AS ln, sum(bad) AS lb FROM s{k} WHERE seg IS NOT NULL GROUP BY ALL),
 w{k} AS (SELECT host, template, sum(n) AS an, sum(ln) AS al, sum(lb) AS ab FROM n{k} GROUP BY ALL),
 m{k} AS (SELECT n.host, n.template, seg, CASE WHEN n >= 4 AND n >= an * 0.02 AND NOT (ln > 0 AND al > ln AND (ab = 0 OR ab = al OR
   power(lb::DOUBLE / ln - (ab - lb)::DOUBLE / (al - ln), 2) / ((ab::DOUBLE / al) * (1 - ab::DOUBLE / al) * (1.0 / ln + 1.0 / (al - ln))) < 3.84)) THEN seg ELSE '*' END AS name
   FROM n{k} n JOIN w{k} w ON n.host = w.host AND n.template = w.template),
 t{k} AS (SELECT s.host, s.form, CASE WHEN s.seg IS NULL THEN s.template ELSE s.template || '/' || m.name END AS template, segs, pages, labelled, bad
   FROM s{k} s LEFT JOIN m{k} m ON s.host = m.host AND s.template = m.template AND s.seg = m.seg)"""
    return sql + f""",
 f AS (SELECT host, form, template, labelled, bad FROM t{depth}),
 g AS (SELECT host, template, (sum(bad) + 2) / (sum(labelled) + 4) AS purity FROM f GROUP BY ALL)
SELECT page_id, r.host, path, rule, coalesce(by_rule, CASE WHEN purity >= 0.7 THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN f ON r.host = f.host AND r.form = f.form JOIN g ON f.host = g.host AND f.template = g.template
"""


#: Windows of 50 bytes as hex digits, cut from parts of 512 bytes and the 49 after them.
_BYTES_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
 p AS (SELECT doc_id, unnest(range(n)) AS i, unnest(regexp_extract_all(h, '..')) AS x FROM d WHERE n > 0),
 q AS (SELECT doc_id, i // 512 AS k, string_agg(x, '' ORDER BY i) AS part, min(i) AS first FROM p GROUP BY ALL),
 r AS (SELECT doc_id, k, first, part || coalesce(substr(lead(part) OVER (PARTITION BY doc_id ORDER BY k), 1, 98), '') AS part FROM q),
 g AS (SELECT doc_id, first + j AS i, substr(part, 2 * j + 1, 100) AS w FROM (SELECT doc_id, first, part, unnest(range(least(512, length(part) // 2 - 49))) AS j FROM r)),
 m AS (SELECT w, min(doc_id) AS least FROM g GROUP BY w HAVING min(doc_id) < max(doc_id)),
 f AS (SELECT DISTINCT doc_id, i FROM g JOIN m USING (w) WHERE doc_id > least),
 u AS (SELECT p.doc_id, p.i, x, max(f.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS last FROM p LEFT JOIN f ON p.doc_id = f.doc_id AND p.i = f.i),
 t AS (SELECT doc_id, i, x, coalesce(i - last < 50, false) AS gone FROM u),
 s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM t),
 a AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""

ORACLE: dict[str, str] = {
    "op1_suffix_array_dedup": _BYTES_SQL,
    "op4_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS p FROM d),
 h AS (SELECT doc_id, p, w[p:p+12] AS k FROM g),
 m AS (SELECT k, min(doc_id) AS least FROM h GROUP BY k),
 f AS (SELECT DISTINCT h.doc_id, unnest(range(h.p, h.p + 13)) AS i FROM h JOIN m USING (k) WHERE h.doc_id > m.least),
 u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
 j AS (SELECT u.doc_id, u.i, u.x, f.i IS NULL AS kept FROM u LEFT JOIN f ON u.doc_id = f.doc_id AND u.i = f.i),
 a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE NOT kept) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (WHERE kept) AS t FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
""",
    "op5_url_template_filter": _url_sql(),
}
