"""Readers and writers of the raw record and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators import ordered

#: File schemas of the raw records.
PACKET = "packet_id BIGINT, timestamp DOUBLE, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING, packet_len INT, flags STRING, sensor STRING"
HOST_EVENT = "timestamp STRING, actorID STRING, objectID STRING, action STRING, object STRING, hostname STRING, properties STRUCT<image_path: STRING, module_path: STRING, command_line: STRING>"
PROVENANCE = "timestampNanos BIGINT, subject STRING, predicateObject STRING, predicateObjectPath STRING, names ARRAY<STRING>"
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday")


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines, a comma after an object allowed; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json_counted(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, counts), the same rows, and (source_file, good, bad) for every file that has lines."""
    marked = spark.read.schema(f"{schema}, _bad STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("source_file", F.col("_metadata.file_path"))
    marked = ordered.written(marked)  # Spark doesn't count corrupt records straight from a file
    counts = marked.groupBy("source_file").agg(F.count_if(F.col("_bad").isNull()).alias("good"), F.count_if(F.col("_bad").isNotNull()).alias("bad"))
    return marked.filter(F.col("_bad").isNull()).drop("_bad", "source_file"), counts


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: a top-level JSON array per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_tree(spark: SparkSession, path: str, schema: str, pattern: str = "*.json.gz") -> DataFrame:
    """Files below path by pattern; of a truncated archive the readable rows are kept; file names in source_file."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True)
    return reader.json(path).select("*", F.col("_metadata.file_path").alias("source_file"))


def read_avro(spark: SparkSession, path: str) -> DataFrame:
    """The datum of each record; needs Spark's avro package."""
    return spark.read.format("avro").load(path).select("datum.*")


def day_of(file_name: Column) -> Column:
    """Day named in a file name, and None without one."""
    found = F.regexp_extract(F.lower(file_name), "|".join(DAYS), 0)
    return F.when(found != "", found)


def merge_days(packs: DataFrame, file_name: str = "source_file", slice_id: str = "slice_id") -> DataFrame:
    """Day, its order (999 if unknown) and the global id day:slice, or day:NA and a number of its own."""
    day = day_of(F.col(file_name))
    index = F.array_position(F.array(*[F.lit(d) for d in DAYS]), day)
    return packs.withColumns({"day": day, "day_idx": F.coalesce(index.cast("int") - 1, F.lit(999)), "global_id": F.concat_ws(":", F.coalesce(day, F.lit("unknown")), F.coalesce(F.col(slice_id).cast("string"), F.concat(F.lit("NA:"), F.monotonically_increasing_id())))})


def merge_sensors(edge: DataFrame, private: DataFrame) -> DataFrame:
    """Packets of both sensors with a numeric time; order: (timestamp, sensor, packet_id)."""
    both = edge.withColumn("sensor", F.lit("edge")).unionByName(private.withColumn("sensor", F.lit("pvt")), allowMissingColumns=True)
    return both.withColumn("timestamp", F.col("timestamp").try_cast("double")).filter(F.col("timestamp").isNotNull())


def in_time_order(packets: DataFrame, partitions: int | None = None) -> DataFrame:
    """merge_sensors' packets in ranges of time, sorted in each: written as they are, the files follow one another in time.
    Equal times: the edge sensor first, then packet_id."""
    order = ["timestamp", "sensor", "packet_id"]
    n = partitions or int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packets.repartitionByRange(n, *order).sortWithinPartitions(*order)


def host_number(hostname: Column, pattern: str = r"(?i)SysClient(\d{4})\.systemia\.com") -> Column:
    """The host's number, '' if the name has another form."""
    return F.regexp_extract(hostname, pattern, 1)


def host_status(events: DataFrame, hostname: str, targets: list[str]) -> DataFrame:
    """Events with host_id and status: kept (a target), other (another host), missing (no name), bad (another form)."""
    rows = events.withColumn("host_id", host_number(F.coalesce(F.col(hostname), F.lit(""))))
    status = F.when(F.coalesce(F.col(hostname), F.lit("")) == "", "missing").when(F.col("host_id") == "", "bad").when(F.col("host_id").isin(*targets), "kept").otherwise("other")
    return rows.withColumn("status", status)


def write_by(df: DataFrame, path: str, *columns: str, kind: str = "json") -> None:
    """One folder per value of the columns."""
    df.write.partitionBy(*columns).format(kind).save(path)


def write_hypergraph(nodes: DataFrame, edges: DataFrame, incidence: DataFrame, labels: DataFrame, path: str) -> None:
    """The three tables, the label dictionary and a meta row (counts, label number) below path."""
    for name, table in (("nodes", nodes), ("hyperedges", edges), ("incidence", incidence), ("labels", labels)):
        table.write.parquet(f"{path}/{name}")
    spark = nodes.sparkSession
    n = [spark.read.parquet(f"{path}/{name}").count() for name in ("nodes", "hyperedges", "incidence", "labels")]
    spark.createDataFrame([tuple(n)], "num_nodes long, num_hyperedges long, nnz long, num_labels long").write.json(f"{path}/meta")


def write_confusion(counts: DataFrame, labels: list[str], path: str) -> None:
    """counts(y, pred, n) as a CSV of true rows by predicted columns, in label order, zeros where nothing was counted."""
    confusion_matrix(counts, labels).write.option("header", True).csv(path)


def confusion_matrix(counts: DataFrame, labels: list) -> DataFrame:
    """(true, one column for each label). Labels are few: one column each."""
    every = counts.sparkSession.createDataFrame([(x,) for x in labels], counts.select(F.col("y").alias("true")).schema)
    wide = counts.groupBy(F.col("y").alias("true")).pivot("pred", labels).agg(F.sum("n"))
    return every.join(wide, "true", "left").na.fill(0).orderBy("true")


def write_evidence(packs: DataFrame, path: str) -> None:
    """A line '[Slice id] sentence' per pack."""
    packs.select(F.format_string("[Slice %s] %s", F.col("slice_id").cast("string"), "evidence_sentence")).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Predictions, confusion tables and metric rows."""
    df.write.mode("append").option("header", True).csv(path)


def merge_read_days(rows: DataFrame, slice_id: str = "slice_id") -> DataFrame:
    """S10 over objects.read_objects' rows: the good ones with day, day_idx and global_id, where a record without a slice id
    has day:NA: and the number of its line among all lines of all files, taken by day and then by name.

    Only the files' line counts are added up in order: one row a file.
    """
    name = F.lower(F.element_at(F.split("source_file", "/"), -1))
    day = day_of(name)
    index = F.coalesce(F.array_position(F.array(*[F.lit(d) for d in DAYS]), day).cast("int") - 1, F.lit(999))
    ends = rows.filter("outcome = 'file'").select("source_file", day.alias("day"), index.alias("day_idx"), F.col("line").alias("_lines"), name.alias("_name"))
    before = F.sum("_lines").over(Window.orderBy("day_idx", "_name", "source_file").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("_before", F.coalesce(before, F.lit(0))).select("source_file", "day", "day_idx", "_before")
    told = rows.filter("outcome = 'good'").join(ends, "source_file")
    number = F.coalesce(F.col(slice_id).cast("string"), F.concat(F.lit("NA:"), F.col("line") + F.col("_before")))
    return told.withColumn("global_id", F.concat_ws(":", F.coalesce("day", F.lit("unknown")), number)).drop("_before", "record", "outcome")
