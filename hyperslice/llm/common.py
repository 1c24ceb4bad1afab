"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import threading
import uuid
import weakref
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (single machine, tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_open = threading.local()  # the tables written so far in each settled() that runs
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    Shuffle files of the job go when it ends, as nothing reads them again; else they stay until the driver collects garbage.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    for tables in getattr(_open, "tables", [])[-1:]:
        tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop(df: DataFrame) -> None:
    """Delete the table that materialize() or settled() returned as df; nothing may read it afterwards."""
    if path := _paths.pop(df, None):
        _delete(df.sparkSession, path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s result as materialize() has it; the tables that make() wrote are deleted then, as nothing else reads them."""
    stack = _open.__dict__.setdefault("tables", [])
    stack.append(own := [])
    try:
        df = make()
    finally:
        stack.pop()
    out = materialize(df, name)
    for path in own:
        _delete(df.sparkSession, path)
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows, which bounds the Python objects made at a time; at least one piece each."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def id_bucket(col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; ids that are null count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


def crc_mod(value: int | None, modulus: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus


def ascii_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case (bytes.lower and bytes.split are ASCII only)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()
