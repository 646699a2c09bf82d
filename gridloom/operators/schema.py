"""Statistics and schemas of semi-structured documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def int_width(least: Column, most: Column) -> Column:
    """The narrowest storage of a range: const, u8, s8, u16, s16, else var."""
    return F.when(least == most, "const").when((least >= 0) & (most <= 255), "u8").when((least >= -128) & (most <= 127), "s8").when((least >= 0) & (most <= 65535), "u16").when((least >= -32768) & (most <= 32767), "s16").otherwise("var")


def field_stats(df: DataFrame, key: str, number: Column, text: str) -> DataFrame:
    """(key, mn, mx, max_len, n_len) of a number and a text of each row."""
    return df.groupBy(key).agg(F.min(number).alias("mn"), F.max(number).alias("mx"), F.max(F.length(text)).cast("long").alias("max_len"), F.countDistinct(F.length(text)).alias("n_len"))


def inferred_schema(df: DataFrame, column: str) -> DataFrame:
    """(schema): one type that holds all documents (JSON text or variant), merged in parts as any aggregate."""
    own = F.col(column) if dict(df.dtypes)[column] == "variant" else F.parse_json(F.col(column))
    return df.agg(F.schema_of_variant_agg(own).alias("schema"))


def document_shapes(df: DataFrame, column: str) -> DataFrame:
    """(shape, n): the documents' own types, most frequent first in no order."""
    own = F.col(column) if dict(df.dtypes)[column] == "variant" else F.parse_json(F.col(column))
    return df.groupBy(F.schema_of_variant(own).alias("shape")).agg(F.count("*").alias("n"))


def shape_lookup(df: DataFrame, parts: Column, shapes: DataFrame, shape_parts: Column, code: str = "code") -> DataFrame:
    """Adds the code of the shape whose list of parts a row has; null for lists that no shape has."""
    def signature(x):
        return F.array_join(F.transform(x, lambda p: F.concat(F.length(p), F.lit(":"), p)), "")

    known = shapes.select(signature(shape_parts).alias("_s"), code)
    return df.withColumn("_s", signature(parts)).join(known, "_s", "left").drop("_s")


def extract(document: Column, path: str, kind: str, strict: bool = False, default=None) -> Column:
    """A typed value at a path of a variant; strict fails on a wrong type, else null or the default."""
    found = F.variant_get(document, path, kind) if strict else F.try_variant_get(document, path, kind)
    return found if default is None else F.coalesce(found, F.lit(default))
