"""The corpus pipeline: quality rules, near duplicates, repeated passages, decontamination, mixing.

Each stage takes the documents that the one before has written and returns the documents it keeps,
with the columns doc_id, text, lang, source, n_chars; the last returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrials.llm.common import stored, table
from retrials.llm.decontaminate import drop_contaminated
from retrials.llm.mixing import mix
from retrials.llm.near_duplicates import near_duplicates
from retrials.llm.quality_rules import clean_documents, quality_rules
from retrials.llm.suffix_array import remove_repeated_bytes

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines over the limit go from the rest."""
    return _documents(clean_documents(docs, quality_rules(docs)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates on five-word shingles, similarity 0.8: one row of each group stays, that of the smallest id."""
    found = near_duplicates(docs, k=5, percent=80).where("kept")
    # rows that share the smallest id: the one with the smallest text hash stands for the group; a null id stands for its own text
    linked = found.where("component_id is not null").groupBy("component_id").agg(F.min("tkey").alias("tkey")).withColumnRenamed("component_id", "doc_id")
    stay = linked.unionByName(found.where("component_id is null").select("doc_id", "tkey").distinct()).alias("s")
    d = docs.withColumn("tkey", F.xxhash64("text")).alias("d")
    same = F.col("d.tkey").eqNullSafe(F.col("s.tkey")) & F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))
    return d.join(stay, same, "left_semi").dropDuplicates(["tkey", "doc_id"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every place of a string of 200 bytes that occurs more than once is cut out."""
    out = remove_repeated_bytes(docs, length=200, carry=("lang", "source"), as_text=True)
    return _documents(out.withColumnRenamed("kept", "text"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents taken, with the words taken of each."""
    return mix(docs).where("taken > 0")


STAGES = [("quality rules", quality), ("near duplicates", one_of_each_group), ("repeated passages", repeated_passages),
          ("decontamination", decontaminated), ("mixing", mixed)]

#: Near duplicates, repeated passages and substitution-tolerant overlaps can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
