"""Archives: folders and zip files as rows of named bytes, and back."""

from __future__ import annotations

import io
import zipfile

from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "path string, length long, content binary"


def scan_folder(spark: SparkSession, path: str, with_content: bool = True) -> DataFrame:
    """(path, length, content) of all files below a folder; without content only names and sizes are read.

    Spark's reader passes over files without bytes.  These come from its own listing, which the driver holds anyway.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = F.lit(path.rstrip("/") + "/")

    def relative(rows: DataFrame) -> DataFrame:
        name = F.regexp_replace(F.col("path"), "^file:/*", "/")
        return rows.withColumn("path", F.when(name.startswith(root), F.substr(name, F.length(root) + 1)).otherwise(F.col("path")))

    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "path string")
    empty = relative(listed).join(relative(files.select("path")), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    return relative(files).select("path", "length", "content").union(empty).select("path", "length", *(["content"] if with_content else []))


def scan_zip(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the entries of zip files; folders are left out."""
    return unzip(spark.read.format("binaryFile").load(path).select("content"))


def unzip(files: DataFrame) -> DataFrame:
    """The entries of zip files (content)."""

    def run(parts):
        for pdf in parts:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for e in z.infolist():
                        if not e.is_dir():
                            yield pd.DataFrame({"path": [e.filename], "length": [e.file_size], "content": [z.read(e)]})

    return files.mapInPandas(run, ENTRIES)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A zip file by its extension, else a folder."""
    return scan_zip(spark, path) if path.lower().endswith(".zip") else scan_folder(spark, path)


def write(entries: DataFrame, path: str) -> int:
    """Writes entries (path, content) as a zip file or below a folder, by the path's extension; on a folder that all executors share.  Gives the number of entries."""
    from gridloom.sources.region import write_files

    if not path.lower().endswith(".zip"):
        return write_files(entries, path)
    folder, _, name = path.rpartition("/")
    whole = zip_bytes(entries.select("path", "content").withColumn("_g", F.lit(name)), "_g").select(F.col("_g").alias("path"), "content")
    write_files(whole, folder or ".")
    return entries.count()


def zip_bytes(entries: DataFrame, group: str) -> DataFrame:
    """(group, content): a zip file of the entries (path, content) of each group, by path, with fixed times.

    A zip file is written by one task, so the group bounds its size.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in sorted(zip(pdf["path"], map(bytes, pdf["content"]), strict=True)):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"{path} leaves the archive")
                z.writestr(zipfile.ZipInfo(path), content, zipfile.ZIP_DEFLATED)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "content": [out.getvalue()]})

    return entries.select(group, "path", "content").groupBy(group).applyInPandas(run, f"{group} string, content binary")
