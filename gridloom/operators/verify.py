"""Digests and comparisons that show that nothing was lost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_digest(df: DataFrame, *columns: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, rows, digest): independent of the order of rows and of how they are partitioned, with repeats counted."""
    own = list(columns or df.columns)
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*own).cast("decimal(38,0)")).alias("digest"))


def section_digests(sections: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """(keys, sha): SHA-256 of each section's payload (binary), after its keys."""
    return sections.select(*keys, F.sha2(F.concat(F.concat_ws(",", *keys).cast("binary"), F.col(payload)), 256).alias("sha"))


def region_digest(sections: DataFrame, region: list[str], keys: list[str], payload: str) -> DataFrame:
    """(region, sha): SHA-256 over the digests of a region's sections, in order.  A region has a bounded number of sections."""
    each = section_digests(sections, [*region, *keys], payload)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*keys, "sha"))), lambda s: s["sha"])
    return each.groupBy(*region).agg(F.sha2(F.array_join(ordered, ""), 256).alias("sha"))


def same_document(a: Column, b: Column) -> Column:
    """Whether two variants hold the same; a variant keeps its keys in order, so their texts agree."""
    return F.to_json(a).eqNullSafe(F.to_json(b))


def progress(df: DataFrame, name: str, size: str):
    """The rows with an observation of their number and of the sum of ``size``: (rows, observation)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), F.sum(size).alias("bytes")), seen


def all_known(df: DataFrame, known: Column, *keys: str) -> DataFrame:
    """(keys, all_known, any_rows)."""
    return df.groupBy(*keys).agg(F.coalesce(F.bool_and(known), F.lit(True)).alias("all_known"), (F.count("*") > 0).alias("any_rows"))


def bits_per_block(df: DataFrame, bits: str, blocks: str) -> DataFrame:
    return df.agg(F.round(F.sum(bits) / F.sum(blocks), 6).alias("bits_per_block"), F.sum(blocks).alias("n_blocks"))
