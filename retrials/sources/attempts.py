"""Attempt directories, token series, prefix tables, shards and rollout dumps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "complete.json"


def _directory(df: DataFrame) -> DataFrame:
    return df.withColumn("directory", F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]+$", 1))


def committed(spark: SparkSession, root: str) -> DataFrame:
    """Directories below ``root`` that hold a completion marker."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", MARKER).load(root)
    return _directory(files.select("_metadata")).select("directory").distinct()


def read_attempts(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Metadata of committed attempts only."""
    meta = _directory(spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata*.json").json(root))
    return meta.join(committed(spark, root), "directory", "left_semi")


def load_tokens(tokens: DataFrame, attempts: DataFrame) -> DataFrame:
    """Token series with their attempt's metadata."""
    return tokens.join(attempts, "run_id")


def read_prefix_tables(spark: SparkSession, root: str) -> DataFrame:
    """All ``features_prefix_<n>.parquet`` tables with n as a column."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/features_prefix_*.parquet")
    number = F.regexp_extract("_metadata.file_path", r"features_prefix_(\d+)\.parquet", 1)
    return rows.withColumn("prefix_length", number.cast("long"))


def write_prefix_tables(features: DataFrame, root: str) -> None:
    """One directory per prefix, pruned by partition on reading."""
    features.write.mode("overwrite").partitionBy("prefix_length").parquet(root)


def read_shards(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Several Parquet shards, only the named columns."""
    return spark.read.parquet(*paths).select(*columns)


def explode_rollouts(documents: DataFrame, ids: Sequence[str], samples: str = "samples") -> DataFrame:
    """One document per problem holding a list of samples -> one row per sample."""
    return documents.select(*ids, F.posexplode(samples).alias("sample", "text"))


def states_of(runs: DataFrame, states: DataFrame) -> DataFrame:
    """Hidden states per run; a run without a usable payload keeps one row of NULLs."""
    usable = states.where(F.col("vec").isNotNull() & (F.size("vec") > 0))
    return runs.join(usable, "run_id", "left")
