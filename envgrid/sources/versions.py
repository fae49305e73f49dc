"""A dated table that changes in one step: new files first, then one pointer.

A commit writes the rows of its dates to a folder of its own and then a manifest, which names for each date the folder that
holds it. A manifest becomes the table's state by one rename to the next version number, which fails if that number is
taken. So a reader sees the state before a commit or after it, never between, and a writer that dies before the rename leaves
files that nobody reads. Each manifest keeps the keys of the batches that went in; a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer took the version number first; its state has to be read again."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, in order."""
    fs, at = _fs(spark, f"{path}/_versions")
    if not fs.exists(at):
        return []
    return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """{version, schema, days: {date: folder}, batches} of a version, by default the latest; an empty one before the first commit."""
    have = versions(spark, path)
    if not have and version is None:
        return {"version": 0, "schema": None, "days": {}, "batches": []}
    name = f"{path}/_versions/{have[-1] if version is None else version:010d}.json"
    return json.loads(spark.read.text(name, wholetext=True).first()[0])


def write_rows(df: DataFrame, path: str, folder: str, day: str) -> None:
    df.repartition(day).sortWithinPartitions(day, *[c for c in df.columns if c != day][:1]).write.option("compression", "snappy").partitionBy(day).parquet(f"{path}/data/batch={folder}")


def publish(spark: SparkSession, path: str, state: dict) -> None:
    """Makes state the table's, or raises Conflict if its version is there already."""
    name = f"{state['version']:010d}.json"
    fs, temporary = _fs(spark, f"{path}/_pending/{uuid.uuid4().hex}.json")
    out = fs.create(temporary, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    _, target = _fs(spark, f"{path}/_versions/{name}")
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(temporary, target):
        fs.delete(temporary, False)
        raise Conflict(f"version {state['version']} of {path} is taken")


def commit(df: DataFrame, path: str, batch: str, day: str = "report_date", dates: DataFrame | None = None, tries: int = 5) -> int:
    """The rows of df replace those of its dates; returns the version that holds them.

    batch names the change: where it is in the table already, nothing is written. dates (a column of that name) may name
    further dates, which then have no rows. Of two writers at once the later one starts again from the other's state.
    """
    spark = df.sparkSession
    folder = None
    for _ in range(tries):
        now = manifest(spark, path)
        if batch in now["batches"]:
            return now["version"]
        if folder is None:
            folder = f"{uuid.uuid4().hex}"
            write_rows(df, path, folder, day)
            schema = df.schema.json()
            written = spark.read.schema(df.schema).parquet(f"{path}/data/batch={folder}").select(day)
            # dates of a record, one row each
            changed = {str(r[0]): folder for r in written.distinct().collect()}
            gone = {str(r[0]) for r in dates.select(day).distinct().collect()} - changed.keys() if dates is not None else set()
        days = {k: v for k, v in now["days"].items() if k not in gone} | changed
        try:
            publish(spark, path, {"version": now["version"] + 1, "schema": schema, "day": day, "days": days, "batches": [*now["batches"], batch]})
            return now["version"] + 1
        except Conflict:
            continue
    raise Conflict(f"{path} changed {tries} times meanwhile")


def read_table(spark: SparkSession, path: str, version: int | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """The rows of a version, by default the latest; only the folders of dates from first to last are read."""
    now = manifest(spark, path, version)
    if now["schema"] is None:
        raise ValueError(f"nothing has been committed to {path}")
    schema, day = StructType.fromJson(json.loads(now["schema"])), now["day"]
    at = [f"{path}/data/batch={f}/{day}={d}" for d, f in sorted(now["days"].items()) if (first is None or d >= first) and (last is None or d <= last)]
    if not at:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*at).select(schema.names)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes all versions but the last ones, and files that none of these names; returns how many folders went. No commit may be under way."""
    have = versions(spark, path)
    named = {(f, d) for v in have[-keep:] for d, f in manifest(spark, path, v)["days"].items()}
    fs, _ = _fs(spark, path)
    for v in have[:-keep]:
        fs.delete(_fs(spark, f"{path}/_versions/{v:010d}.json")[1], False)
    gone = 0
    root = _fs(spark, f"{path}/data")[1]
    for batch in fs.listStatus(root) if fs.exists(root) else ():
        folder = batch.getPath().getName().partition("=")[2]
        kept = 0
        for day in fs.listStatus(batch.getPath()):
            if (folder, day.getPath().getName().partition("=")[2]) in named:
                kept += 1
            elif day.isDirectory():
                fs.delete(day.getPath(), True)
                gone += 1
        if not kept:
            fs.delete(batch.getPath(), True)
    return gone


def commit_batches(path: str, stream: str, day: str = "report_date"):
    """A foreachBatch function whose batches are commits, each known by the stream's name and its number."""
    def write(batch: DataFrame, number: int) -> None:
        commit(batch, path, f"{stream}/{number}", day)

    return write
