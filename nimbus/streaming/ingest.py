"""Resumable ingestion of landed files with Structured Streaming.

The file source remembers which files it has already read in its checkpoint,
so a rerun picks up only files landed since the previous run. Every micro-batch
is written by its number: its rows to the folder ``ingest_batch=N`` of the
sink, then its progress to the folder of the same name beside the sink, and
only then does the stream commit it. A run that dies anywhere in between does
the same batch again, and both folders are replaced, so neither rows nor
progress are ever counted twice or lost.
``trigger(availableNow=True)`` turns the stream into a bounded batch job that
processes everything available and stops.

The checkpoint is kept beside the sink by default, and a run refuses to start
when the sink holds batches that the checkpoint never planned. ``read_sink``
reads the rows without the batch number.
"""

from __future__ import annotations

import datetime as dt
import os
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.observation import Observation

from nimbus.schema import OBSERVATION, PAYLOAD
from nimbus.sources import files
from nimbus.sources.payload import flatten_payload

PROGRESS = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("num_input_rows", T.LongType()),
        T.StructField("failed_rows", T.LongType()),
        T.StructField("processed_rows_per_second", T.DoubleType()),
        T.StructField("cumulative_rows", T.LongType()),
    ]
)

BATCH = "ingest_batch"


def checkpoint_of(sink: str) -> str:
    """The default checkpoint folder: a sibling of the sink."""
    return sink.rstrip("/") + "_checkpoint"


def progress_of(sink: str) -> str:
    """The table of all runs' progress: a sibling of the sink."""
    return sink.rstrip("/") + "_progress"


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system (Spark's own readers hide logs and empty folders)."""
    fs, path = files._at(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def _logged(spark: SparkSession, folder: str) -> set[int]:
    """Batch numbers in a checkpoint log (its file names)."""
    names = [n.removesuffix(".compact") for n in _names(spark, folder)]
    return {int(n) for n in names if n.isdigit()}


def _written(spark: SparkSession, folder: str) -> set[int]:
    """Batch numbers that have a folder."""
    return {int(n.removeprefix(BATCH + "=")) for n in _names(spark, folder) if n.startswith(BATCH + "=")}


def _check_agreement(spark: SparkSession, sink: str, checkpoint: str) -> None:
    """Raises when the sink holds batches that the checkpoint never planned."""
    if "_spark_metadata" in _names(spark, sink):
        raise ValueError(f"{sink} was written by Spark's own file sink; give a new sink")
    # a batch is planned in the checkpoint before any of its rows are written
    planned, written = _logged(spark, checkpoint + "/offsets"), _written(spark, sink)
    if written and max(written) > max(planned, default=-1):
        raise ValueError(
            f"{sink} holds batches up to {max(written)} that the checkpoint {checkpoint} does not know; "
            "files landed since would be skipped. Give the checkpoint that wrote this sink, or a new sink"
        )


def _run(rows: DataFrame, sink: str, checkpoint: str | None, name: str, partition_by: list[str] | None) -> DataFrame:
    """Write all available micro-batches to the sink; the progress of this run."""
    spark = rows.sparkSession
    ckpt = checkpoint or checkpoint_of(sink)
    _check_agreement(spark, sink, ckpt)
    done: list[int] = []

    def land(batch: DataFrame, batch_id: int) -> None:
        counts = land_batch(batch, batch_id, sink, partition_by)
        record_progress(batch.sparkSession, sink, batch_id, *counts)
        done.append(batch_id)

    query = (
        rows.writeStream.queryName(f"{name}_{time.time_ns()}").foreachBatch(land)
        .option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return ingest_history(spark, sink).where(F.col("batch_id").isin(done))


def land_batch(batch: DataFrame, batch_id: int, sink: str, partition_by: list[str] | None = None) -> tuple[int, int, float]:
    """Replaces the batch's folder of the sink; (rows, rows without a usable date, seconds)."""
    spark, started = batch.sparkSession, time.time()
    date = F.col("DATE")
    invalid = date.isNull() | F.try_to_date(date.cast("string")).isNull()
    seen = Observation()
    writer = batch.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(invalid).alias("failed")).write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    files.replace_dataset(spark, f"{sink.rstrip('/')}/{BATCH}={batch_id}", writer.parquet)
    return files.observed(seen, "rows"), files.observed(seen, "failed"), time.time() - started


def record_progress(spark: SparkSession, sink: str, batch_id: int, rows: int, failed: int, seconds: float) -> None:
    """Replaces the batch's row of the progress; the total goes on from the batches before it."""
    before = ingest_history(spark, sink).where(F.col("batch_id") < batch_id).agg(F.sum("num_input_rows")).first()[0] or 0
    now = dt.datetime.now(dt.timezone.utc).isoformat(timespec="milliseconds")
    row = (batch_id, now, rows, failed, rows / seconds if seconds > 0 else None, int(before) + rows)
    one = spark.createDataFrame([row], PROGRESS).coalesce(1)
    files.replace_dataset(spark, f"{progress_of(sink)}/{BATCH}={batch_id}", one.write.parquet)


def read_sink(spark: SparkSession, sink: str, schema: T.StructType | None = None) -> DataFrame:
    """All ingested rows, without the batch number; an empty sink needs a schema."""
    root, name = os.path.split(sink.rstrip("/"))
    if not _written(spark, sink):
        if schema is None:
            raise ValueError(f"nothing has been ingested into {sink}; give a schema")
        return spark.createDataFrame([], schema)
    return files.scan_dataset(spark, root, name, schema).drop(BATCH)


def ingest_history(spark: SparkSession, sink: str) -> DataFrame:
    """Progress of all runs into a sink, one row per micro-batch."""
    if not _written(spark, progress_of(sink)):
        return spark.createDataFrame([], PROGRESS)
    return spark.read.schema(PROGRESS).parquet(progress_of(sink)).select(*PROGRESS.names)


def ingest_totals(history: DataFrame) -> DataFrame:
    """Totals of all runs: batches, rows, failed and valid rows, and the valid share in percent."""
    rows, failed = F.coalesce(F.sum("num_input_rows"), F.lit(0)), F.coalesce(F.sum("failed_rows"), F.lit(0))
    return history.agg(
        F.count(F.lit(1)).alias("batches"), rows.alias("rows"), failed.alias("failed_rows"),
        (rows - failed).alias("valid_rows"),
        F.round(F.try_divide((rows - failed) * F.lit(100.0), rows), 2).alias("valid_percent"),
    )


def ingest_share(spark: SparkSession, landing: str, sink: str, checkpoint: str | None = None, glob: str | None = None) -> DataFrame:
    """How much of a landing folder is ingested: files and bytes landed, done and remaining, and the percentages done.

    The files done are those that the file source logged for committed batches.
    """
    ckpt = checkpoint or checkpoint_of(sink)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    landed = files._listing(spark, landing, glob).select(plain("path").alias("path"), "length")
    logs, committed = f"{ckpt}/sources/0", _logged(spark, ckpt + "/commits")
    entry = T.StructType([T.StructField("path", T.StringType()), T.StructField("batchId", T.LongType())])
    seen = spark.createDataFrame([], "path string")
    if committed and _logged(spark, logs):
        lines = spark.read.text([f"{logs}/{n}" for n in _names(spark, logs) if n.removesuffix(".compact").isdigit()])
        read = lines.select(F.from_json("value", entry).alias("e")).where(F.col("e.batchId") <= max(committed))
        seen = read.select(plain("e.path").alias("path")).distinct()
    marked = landed.join(seen.withColumn("done", F.lit(True)), "path", "left")
    done = F.coalesce("done", F.lit(False))
    share = lambda part, whole: F.round(F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(100.0)), 2)
    sums = marked.agg(
        F.count(F.lit(1)).alias("files_landed"), F.count_if(done).alias("files_done"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes_landed"),
        F.coalesce(F.sum(F.when(done, F.col("length"))), F.lit(0)).alias("bytes_done"),
    )
    return sums.select(
        "files_landed", "files_done", (F.col("files_landed") - F.col("files_done")).alias("files_remaining"),
        share(F.col("files_done"), F.col("files_landed")).alias("files_percent"),
        "bytes_landed", "bytes_done", (F.col("bytes_landed") - F.col("bytes_done")).alias("bytes_remaining"),
        share(F.col("bytes_done"), F.col("bytes_landed")).alias("bytes_percent"),
    )


def _csv_header(spark: SparkSession, landing: str) -> list[str] | None:
    """Column names of the landed CSV files; None where nothing has landed yet."""
    try:
        return spark.read.option("header", True).csv(landing).columns
    except AnalysisException as exc:
        nothing = {"UNABLE_TO_INFER_SCHEMA"} | ({"PATH_NOT_FOUND"} if any(c in landing for c in "*?[{") else set())
        if exc.getCondition() in nothing:
            return None
        raise


def resumable_ingest(
    spark: SparkSession,
    landing: str,
    sink: str,
    checkpoint: str | None = None,
    fmt: str = "csv",
    schema: T.StructType = OBSERVATION,
    max_files_per_trigger: int | None = None,
    partition_by: list[str] | None = None,
    name: str = "ingest",
) -> DataFrame:
    """Write every not-yet-ingested landed file to the Parquet ``sink``.

    CSV columns are taken by the header's names, as in ``scan_csv``; a file
    whose header differs from the first one's raises. Returns the progress of
    this run (one row per micro-batch; none where nothing has landed).
    """
    reader = spark.readStream.format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt != "csv":
        return _run(reader.schema(schema).load(landing), sink, checkpoint, name, partition_by)
    header = _csv_header(spark, landing)
    if header is None:
        return spark.createDataFrame([], PROGRESS)
    text = files.header_checked(reader, header or schema.names).load(landing)
    typed = files.typed_by_name(text, schema)
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in typed.columns]
    return _run(typed.select("*", *absent).select(*schema.names), sink, checkpoint, name, partition_by)


def ingest_payloads(
    spark: SparkSession,
    landing: str,
    sink: str,
    checkpoint: str | None = None,
    name: str = "payloads",
) -> DataFrame:
    """Flatten every not-yet-ingested landed payload document into the sink.

    Landed documents are JSON files (one document per line, as written by
    ``land_raw_json``); each micro-batch is flattened with the same narrow
    ``posexplode`` as the batch path and written as observation rows.
    """
    fields = [f for f in PAYLOAD.fields if f.name != "location_name"]
    schema = T.StructType([*fields, T.StructField("location_name", T.StringType())])
    docs = spark.readStream.schema(schema).json(landing)
    rows = flatten_payload(docs.select(F.struct(*[F.col(f.name) for f in PAYLOAD.fields]).alias("doc")))
    return _run(rows, sink, checkpoint, name, None)
