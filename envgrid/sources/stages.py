"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a local folder and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Staged tables of this program that are still there.
STAGED: dict[str, SparkSession] = {}


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, which ends its lineage."""
    path = f"{shared_dir(df.sparkSession)}/grid-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    STAGED[path] = df.sparkSession
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unstage(df: DataFrame) -> None:
    """Deletes the files of a staged table that a later one has taken the place of."""
    STAGED.pop(df.staged_at, None)
    delete(df.sparkSession, df.staged_at)


def clear_staged() -> int:
    """Deletes all tables that this program's operators have staged; returns how many. For the time after a result is written, between jobs."""
    n = len(STAGED)
    while STAGED:
        path, spark = STAGED.popitem()
        delete(spark, path)
    return n


def stage_once(spark: SparkSession, path: str, make, inputs: str = "") -> DataFrame:
    """The table at path, made and written first where it is not there. inputs says what it is made from: with other inputs it is another table."""
    path = f"{path}-{hashlib.sha256(inputs.encode()).hexdigest()[:16]}" if inputs else path
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
