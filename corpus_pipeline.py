"""The corpus pipeline: toxicity, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of docs, those that documents hasn't too; rows that a stage doesn't
change stay as they are.

In all stages null texts count as empty and stay null, empty and very long texts are read whole, repeated rows stay or go
together, rows without doc_id are kept, and an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import _common as c
from gridloom.llm.packing import best_fit
from gridloom.llm.pii import pii
from gridloom.llm.simhash import near_duplicates
from gridloom.llm.substring_dedup import substring_dedup
from gridloom.llm.toxicity import teaching
from gridloom.llm.toxicity import toxicity as scored

#: SQL can't express these stages; tests hold them against plain versions.
ORACLE_SQL = None


def _with_text(docs: DataFrame, row: str, text: Column, changed: Column) -> list[Column]:
    """The columns of docs, which ``row`` holds, with the new text and its length where it changed."""
    new = {"text": text, "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return [F.when(changed, new[k]).otherwise(F.col(f"{row}.`{k}`")).alias(k) if k in new else F.col(f"{row}.`{k}`").alias(k) for k in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.3 go; among others that of a null or empty text doesn't unless most such examples are toxic."""
    labels = teaching(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = scored(docs, labels, evidence=0, with_row=True)
    return found.filter("score < 0.3").select("row.*")


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id.  Null and empty texts are one group.  Rows without doc_id stay, and rows that share one stay or go together."""
    groups = near_duplicates(docs, shingle=5, similarity=0.8)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{k}`" for k in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 13 words that an earlier document has too go from the text; other texts stay as they are.

    The other columns go along as JSON, so they are of types that JSON can hold.
    """
    others = [f for f in docs.schema if f.name not in ("doc_id", "text")]
    own = T.StructType([*others, T.StructField("no text", T.BooleanType())])
    note = F.to_json(F.struct(*(F.col(f"`{f.name}`") for f in others), F.col("text").isNull().alias("no text")))
    found = substring_dedup(docs, window=13, note=note).withColumn("row", F.from_json("note", own))
    kept = found.select("n_removed", "left", F.struct("doc_id", F.when(~F.col("row.`no text`"), F.col("left")).alias("text"), *(F.col(f"row.`{f.name}`") for f in others)).alias("row"))
    return kept.select(*_with_text(docs, "row", F.col("left"), F.col("n_removed") > 0))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the name of their kind."""
    return pii(docs, with_row=True).select(*_with_text(docs, "row", F.col("redacted"), F.col("spans") != ""))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in bins of 2,048 words; documents without words are one piece of size 0."""
    return best_fit(docs, capacity=2048)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicate_removal", near_duplicate_removal),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  What a stage returns is stored in the shared folder until the next one's is."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = c.stored(docs, f"pipeline-{name}")
            if last is not None:
                c.dropped(last)
            last = docs
    return docs
