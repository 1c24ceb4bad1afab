"""Ordered scans in blocks: positions, last values and folds over a long stream without one task that reads it all.

A block is a range of the order between quantiles over all rows, computed from the row alone, so that every pass deals
rows alike. What a block needs of the rows before it comes from one small row for each block, taken in order.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F


#: Spark's setting that removes a job's shuffle files when the job ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the folder of spark.checkpoint.dir: read again, not computed again, of a size that plans know, and there
    when executors are lost. Only a local master may do without that setting. The job's shuffle files go when it ends, as
    nothing reads them again; else they stay until the driver collects garbage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-"))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    before = df.sparkSession.conf.get(CLEANUP, "false")
    df.sparkSession.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        df.sparkSession.conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cuts(df: DataFrame, column: str, blocks: int) -> list[float]:
    """The borders of `blocks` ranges of a number column with about as many rows each; fewer where values repeat."""
    inner = [i / blocks for i in range(1, blocks)] or [0.5]
    found = df.select(F.percentile_approx(F.col(column).cast("double"), inner, max(10_000, 10 * blocks)).alias("c")).first()["c"]
    return [-math.inf, *sorted(set(found or [])), math.inf]


def in_blocks(df: DataFrame, column: str, borders: list[float], name: str = "block") -> DataFrame:
    """df with the number of the range its value lies in (found by bisection); null values lie behind the last."""
    last = len(borders) - 1
    if last == 1:
        return df.withColumn(name, F.when(F.col(column).isNull(), 1).otherwise(0))
    at = f"_{name}"
    told = Bucketizer(splits=borders, inputCol=at, outputCol=name, handleInvalid="keep").transform(df.withColumn(at, F.coalesce(F.col(column).cast("double"), F.lit(math.nan))))
    return told.withColumn(name, F.col(name).cast("int")).drop(at)


def carried(df: DataFrame, stream: str, block: str, **values) -> DataFrame:
    """(stream, block, values): for every block of df the last value that is not null in the stream's blocks before it.

    values are aggregates of a block, as Columns. One row a block and stream takes part in the windows.
    """
    before = Window.partitionBy(stream).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    by = df.groupBy(stream, block).agg(*[v.alias(k) for k, v in values.items()])
    return by.select(stream, block, *[F.last(k, ignorenulls=True).over(before).alias(k) for k in values])


def summed(df: DataFrame, stream: str, block: str, value, name: str) -> DataFrame:
    """(stream, block, name): the sum of value (an aggregate of a block) over the stream's blocks before each."""
    before = Window.partitionBy(stream).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    by = df.groupBy(stream, block).agg(value.alias(name))
    return by.select(stream, block, F.coalesce(F.sum(name).over(before), F.lit(0)).cast("long").alias(name))
