"""Problem bundles as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "problem_id string, dataset string, source_repository string, source_split string, source_index bigint, problem string, "
    "reference_answer string, reference_solution string, level bigint, category string, research_split string"
)


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    """Canonical records; blank lines are skipped, a malformed record fails the read."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)


def write_problems(problems: DataFrame, path: str, assignments: str) -> None:
    """The bundle, and next to it the id-to-split map."""
    problems.write.mode("overwrite").json(path)
    problems.select("problem_id", "research_split").write.mode("overwrite").json(assignments)


def split_counts(problems: DataFrame) -> DataFrame:
    return problems.groupBy("level", "research_split").agg(F.count(F.lit(1)).alias("problems"))
