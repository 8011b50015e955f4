"""File manifests and their audit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrials.sources.remote import blocks


#: Files up to this size are digested from Spark's own binary reader, larger ones block by block.
WHOLE = 64 << 20


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            digest = hashlib.sha256()
            for part in blocks(path):
                digest.update(part)
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([size], pa.int64()), pa.array([digest.hexdigest()], pa.string())],
                                             names=["path", "length", "sha256"])


def file_manifest(spark: SparkSession, root: str, pattern: str = "*", whole: int = WHOLE) -> DataFrame:
    """Path relative to ``root``, size and SHA-256 of every file below it, empty files included.

    Scans leave out empty files, so those come from the listing that the driver holds for any scan.
    A task never holds more than ``whole`` bytes of a file: the reader takes files up to that size
    (the size filter is pushed into it), larger ones stream through a digest in the tasks, one file a task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    small = files.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select("path", "length").mapInArrow(_digests, "path string, length long, sha256 string")
    top = root.rstrip("/").split("://")[-1] + "/"
    inner = F.substr("path", F.locate(top, F.col("path")) + F.lit(len(top))).alias("file")
    listed = spark.createDataFrame([(unquote(x),) for x in files.inputFiles()], "path string").select(inner)
    empty = listed.join(files.select(inner), "file", "left_anti").select(
        "file", F.lit(0).cast("long").alias("size_bytes"), F.sha2(F.lit("").cast("binary"), 256).alias("sha256"))
    return small.union(large).select(inner, F.col("length").alias("size_bytes"), "sha256").union(empty)


def audit_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status per file: ok, missing, unexpected, size or digest mismatch."""
    a = found.select("file", F.col("size_bytes").alias("s"), F.col("sha256").alias("d"))
    b = manifest.select("file", F.col("size_bytes").alias("ms"), F.col("sha256").alias("md"))
    status = (
        F.when(F.col("d").isNull(), "missing").when(F.col("md").isNull(), "unexpected")
        .when(F.col("s") != F.col("ms"), "size_mismatch").when(F.col("d") != F.col("md"), "digest_mismatch").otherwise("ok")
    )
    return a.join(b, "file", "full_outer").select("file", status.alias("status"))
