"""Cut a plan at a small table that several branches read.

The table is written to the shared folder named by ``spark.checkpoint.dir`` and read
back, so a lost executor never forces the base tables to be scanned again and each
further branch starts from the reduced table.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode."""
    named = spark.conf.get(SETTING, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def materialize(df: DataFrame) -> DataFrame:
    """``df`` as a written table; use it for reduced tables with more than one reader."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/retrials/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
