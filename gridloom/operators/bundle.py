"""Bundles of small files: assignment by running size, and the bundles' bytes."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.bits import unvarints, varints
from gridloom.operators.ranges import with_range

#: Bytes after which a bundle is closed.
BUNDLE_BYTES = 4 << 20
#: Types of a bundle's entries.
END, PLAIN, GZIPPED = 0, 1, 2


def running_bundles(df: DataFrame, size: str, order: str, cap: int) -> DataFrame:
    """Adds bundle: floor((running size - 1) / cap) in order.

    The running sum has two levels, so that no task sees all rows: rows fall into ranges of the order column, each
    range's sum is added up on its own, and ranges (as many as there are partitions) get the sums before them.
    """
    ranged = with_range(df, order)
    local = ranged.withColumn("_run", F.sum(size).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    totals = ranged.groupBy("_p").agg(F.sum(size).alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    return local.join(F.broadcast(before), "_p").withColumn("bundle", F.floor((F.col("_run") + F.col("_before") - 1) / cap).cast("long")).drop("_p", "_run", "_before")


def next_fit(df: DataFrame, size: str, order: str, group: str, cap: int = BUNDLE_BYTES) -> DataFrame:
    """Adds bundle: a new one in a group begins with the first row after the bundle so far has exceeded ``cap``.

    The rule is sequential; a group (a folder, a range of names) is streamed through one task, in order, in bounded memory.
    """
    import pyarrow as pa

    dealt = df.repartition(group).sortWithinPartitions(group, order)
    names = df.columns

    def run(batches):
        last, bundle, used = None, 0, 0
        for batch in batches:
            out = []
            for g, n in zip(batch.column(names.index(group)).to_pylist(), batch.column(names.index(size)).to_pylist(), strict=True):
                if g != last:
                    last, bundle, used = g, 0, 0
                elif used > cap:
                    bundle, used = bundle + 1, 0
                used += n or 0
                out.append(bundle)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*names, "bundle"])

    return dealt.mapInArrow(run, df.schema.add("bundle", "long"))


def write_bundle(entries: list[tuple[str, bytes]]) -> bytes:
    """Version 0 and a compressed stream of (type, name, length, data); gzipped files are stored unpacked."""
    out = []
    for name, data in entries:
        kind = PLAIN
        if len(data) >= 10 and data[:3] == b"\x1f\x8b\x08":
            try:
                kind, data = GZIPPED, gzip.decompress(data)
            except (OSError, EOFError, zlib.error):
                kind = PLAIN
        out += [bytes([kind]), name.encode(), b"\0", varints([len(data)]), data]
    return b"\0" + zlib.compress(b"".join(out) + bytes([END]), 6)


def read_bundle(blob: bytes) -> list[tuple[str, bytes]]:
    if blob[:1] != b"\0":
        raise ValueError("unknown bundle version")
    data, at, out = zlib.decompress(blob[1:]), 0, []
    while data[at] != END:
        kind, stop = data[at], data.index(b"\0", at + 1)
        name, at = data[at + 1 : stop].decode(), stop + 1
        end = at
        while data[end] & 128:
            end += 1
        n, at = int(unvarints(data[at : end + 1])[0]), end + 1
        body = data[at : at + n]
        at += n
        out.append((name, gzip.compress(body, 6, mtime=0) if kind == GZIPPED else body))
    return out


def pack_bundles(files: DataFrame, bundle: str = "bundle") -> DataFrame:
    """(bundle, blob) of files (path, content, bundle); a bundle is bounded by its cap."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("path")
        return pd.DataFrame({bundle: [pdf[bundle].iloc[0]], "blob": [write_bundle(list(zip(pdf["path"], map(bytes, pdf["content"]), strict=True)))]})

    return files.select(bundle, "path", "content").groupBy(bundle).applyInPandas(run, f"{bundle} long, blob binary")


def unpack_bundles(bundles: DataFrame, blob: str = "blob") -> DataFrame:
    """(path, content) of bundles."""

    def run(parts):
        for pdf in parts:
            rows = [e for b in pdf[blob] for e in read_bundle(bytes(b))]
            yield pd.DataFrame({"path": [r[0] for r in rows], "content": [r[1] for r in rows]})

    return bundles.select(blob).mapInPandas(run, "path string, content binary")


def gzip_codec(column, level: int = 6, unpack: bool = False, limit: int = 64 << 20):
    """Deflates or inflates a binary column (zlib); null where the unpacked size exceeds ``limit`` or the data is bad."""

    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            if not unpack:
                return zlib.compress(bytes(x), level)
            d = zlib.decompressobj(47)
            try:
                out = d.decompress(bytes(x), limit + 1)
            except zlib.error:
                return None
            return out if len(out) <= limit and d.eof else None

        return data.map(one)

    return run(column)
