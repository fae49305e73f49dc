"""Helpers that the corpus operators share: reading, staged tables, free names, Arrow batches of bounded bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python step holds as objects at one time.
PIECE_BYTES = 4 << 20
#: Rows and bytes in an Arrow batch between the JVM and Python; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


KEYS = ("rid", "rid2")


def row_keys(id_col: str, text_col: str, names: tuple[str, ...] = KEYS) -> list:
    """A row's identity: two hashes of its id and text, 128 bits together."""
    return [F.xxhash64(id_col, text_col).alias(names[0]), F.xxhash64(F.lit(1), text_col, id_col).alias(names[1])]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: Iterable[str], name: str) -> str:
    """name, with underscores behind it until no column in taken has it (in any case); added columns give way to given ones."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of an Arrow batch, so that long texts don't fill a Python worker.

    Plans read these settings when they run, so they stay set in the session; smaller values of the user's are left.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        now = int(now) if now and now.lstrip("-").isdigit() else 0
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a local one and a cluster an error."""
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
    """Writes df to the shared folder and reads it back: lineage ends there and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    STAGED[path] = spark
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unstage(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that later ones have taken the place of."""
    for df in tables:
        STAGED.pop(df.staged_at, None)
        delete(df.sparkSession, df.staged_at)


def clear_staged() -> int:
    """Deletes all tables that this program's operators have staged; returns how many.

    Results are read from staged tables when they are written, so this is for the time after that, between jobs.
    """
    n = len(STAGED)
    while STAGED:
        path, spark = STAGED.popitem()
        delete(spark, path)
    return n


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of batch, each with about most bytes of column, or one longer row."""
    at, held = 0, 0
    for i, n in enumerate(batch.column(column)):
        n = len(n.as_buffer()) if n.is_valid else 0
        if held and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], dict]], schema: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), most: int = PIECE_BYTES) -> DataFrame:
    """Keeps the columns in keep and adds those that make()(texts) returns for the texts of a slice (a list with None for nulls).

    make runs once in each task; a slice has about most bytes of text; schema is the DDL of all columns of the result.
    """
    small_batches(df.sparkSession)
    out = df.select(*keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in pieces(batch, text, most):
                made = fn(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *(v if isinstance(v, pa.Array) else pa.array(v) for v in made.values())], names=[*keep, *made])

    return out.mapInArrow(run, schema)
