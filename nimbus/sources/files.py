"""File sources and sinks: CSV, JSON, Parquet datasets and their listings.

All reads and writes use Spark's distributed readers and writers; nothing is
collected to the driver. Listings (dataset names, sizes, latest file) read
file metadata through the ``binaryFile`` source with the content column
pruned, so they scale with the number of files, not their bytes.
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.observation import Observation

from nimbus.schema import OBSERVATION

# Header of the dashboard's CSV export and the daily columns it holds.
EXPORT_HEADER = ["Date", "Temp Moy", "Temp Min", "Temp Max", "Précipitations", "Humidité"]
EXPORT_COLUMNS = ["DATE", "TEMP_AVG", "TEMP_MIN", "TEMP_MAX", "PRECIPITATION_TOTAL", "HUMIDITY_AVG"]

# Partition columns per stored dataset. Only the row-level table grows with the
# input; the aggregates have a row per day or less and are stored whole.
DEFAULT_PARTITIONING = {"clean": ["YEAR"]}


# --------------------------------------------------------------------- CSV


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = OBSERVATION,
    infer: bool = False,
    by_name: bool = True,
) -> DataFrame:
    """Observation CSV with header.

    By default the declared types are applied by header name (any column
    order or subset; a value that does not parse becomes null). All files of
    one path must have the same header: a file whose header differs raises
    when it is read. With ``by_name=False`` the schema is applied by position,
    and with ``infer`` Spark infers the types.
    """
    reader = spark.read.option("header", True)
    if infer or schema is None:
        return reader.option("inferSchema", True).csv(path)
    if not by_name:
        return reader.schema(schema).csv(path)
    header = reader.csv(path).columns
    return typed_by_name(header_checked(spark.read, header).csv(path), schema)


def header_checked(reader, header: list[str]):
    """A (batch or streaming) CSV reader of text columns that raises on a file with another header."""
    texts = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return reader.schema(texts).option("header", True).option("enforceSchema", False)


def typed_by_name(text: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns cast to the declared types of their names; undeclared columns stay text."""
    types = {f.name: f.dataType for f in schema.fields}
    return text.select(
        *[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in text.columns]
    )


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def export_daily_csv(daily: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The dashboard's six-column export, newest day first."""
    cols = [c for c in EXPORT_COLUMNS if c in daily.columns]
    names = dict(zip(EXPORT_COLUMNS, EXPORT_HEADER))
    out = daily.orderBy(F.col("DATE").desc_nulls_last()).select(
        *[F.col(c).alias(names[c]) for c in cols]
    )
    sink_csv(out, path, mode)


# -------------------------------------------------------------------- JSON


def land_raw_json(payloads: DataFrame, path: str, mode: str = "append") -> None:
    """Keep raw payload documents, one folder per location."""
    payloads.write.mode(mode).partitionBy("location_name").json(path)


def scan_raw_json(spark: SparkSession, path: str) -> DataFrame:
    """Landed payload documents back as a ``doc`` struct column."""
    from nimbus.schema import PAYLOAD

    fields = [f for f in PAYLOAD.fields if f.name != "location_name"]
    schema = T.StructType(fields + [T.StructField("location_name", T.StringType())])
    df = spark.read.schema(schema).json(path)
    return df.select(F.struct(*[F.col(f.name) for f in PAYLOAD.fields]).alias("doc"))


# ----------------------------------------------------------------- Parquet


def observed_all(obs: Observation) -> dict:
    """Observed metrics; none where the rows are known to be none before anything runs (the
    optimizer then drops the observation with them)."""
    from py4j.protocol import Py4JJavaError

    try:
        return obs.get
    except Py4JJavaError as exc:
        if "java.lang.AssertionError" in str(exc):
            return {}
        raise


def observed(obs: Observation, name: str) -> int:
    """An observed count; 0 where there is none."""
    return int(observed_all(obs).get(name) or 0)


def _at(spark: SparkSession, path: str):
    """(file system, path object) of a folder; works for every store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _beside(path: str, word: str) -> str:
    """A hidden sibling of a dataset's folder (listings and readers pass over names that start with a dot)."""
    folder, name = os.path.split(path.rstrip("/"))
    return os.path.join(folder, f".{word}-{name}")


def current_folder(spark: SparkSession, path: str) -> str:
    """Where the dataset of this path is: the folder that a committed replacement points at, else the path itself."""
    fs, pointer = _at(spark, _beside(path, "replaced-by"))
    if not fs.exists(pointer):
        return path
    stream = fs.open(pointer)
    name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    staged = os.path.join(os.path.dirname(path.rstrip("/")), name)
    return staged if _at(spark, staged)[0].exists(_at(spark, staged)[1]) else path


def settle(spark: SparkSession, path: str) -> None:
    """Moves a committed replacement into place; a replacement that a crash left half moved is finished."""
    fs, pointer = _at(spark, _beside(path, "replaced-by"))
    if not fs.exists(pointer):
        return
    staged, place = current_folder(spark, path), _at(spark, path)[1]
    if staged != path:
        fs.delete(place, True)
        if not fs.rename(_at(spark, staged)[1], place):
            raise OSError(f"{staged} holds the dataset of {path} and could not be moved there")
    fs.delete(pointer, False)


def _point_to(spark: SparkSession, path: str, staged: str) -> None:
    """The commit of a replacement: one small file, renamed into place when it is whole."""
    fs, pointer = _at(spark, _beside(path, "replaced-by"))
    _, draft = _at(spark, _beside(path, f"draft-{uuid.uuid4().hex[:12]}"))
    out = fs.create(draft, True)
    out.write(bytearray(os.path.basename(staged).encode()))
    out.close()
    if not fs.rename(draft, pointer):
        raise OSError(f"the replacement of {path} could not be committed")


def replace_dataset(spark: SparkSession, path: str, write) -> None:
    """Replaces a dataset as a whole: ``write`` fills a staged folder, which then takes the path's place.

    The old dataset stays as it is until the staged one is complete. The commit
    is a pointer file beside the dataset that ``scan_dataset`` follows; after it
    the staged folder is moved to the path (a rename). A write that fails leaves
    the old dataset, a crash after the commit leaves the new one, and the next
    replacement finishes the move.
    """
    settle(spark, path)
    staged = _beside(path, f"staged-{uuid.uuid4().hex[:12]}")
    try:
        write(staged)
    except Exception:
        fs, at = _at(spark, staged)
        fs.delete(at, True)
        raise
    _point_to(spark, path, staged)
    settle(spark, path)


def sink_parquet(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    mode: str = "overwrite",
    compression: str = "snappy",
) -> dict:
    """Write a dataset; returns rows written, size and duration.

    ``mode`` is one of Spark's save modes, or ``replace_partitions``:
    ``overwrite`` replaces the whole dataset at once (``replace_dataset``: a
    failed write leaves the old rows), ``replace_partitions`` only the
    partitions that the new rows fall in. The row count is an observed metric
    of the write itself (no second job). Before a partitioned write the rows
    are rebalanced on the partition columns (AQE splits a hot partition and
    merges small ones), so each folder gets a few files of sensible size
    instead of one file per task.
    """
    spark = df.sparkSession
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    obs = Observation(f"written_{os.path.basename(path.rstrip('/'))}_{time.time_ns()}")
    started = time.time()
    dynamic = mode == "replace_partitions"
    writer = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite" if dynamic else mode)
    writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic" if dynamic else "static")
        writer = writer.partitionBy(*partition_by)
    if mode == "overwrite":
        replace_dataset(spark, path, writer.parquet)
    else:
        settle(spark, path)
        writer.parquet(path)
    duration = time.time() - started
    # Names of a write's result.
    return {
        "dataset_name": os.path.basename(path.rstrip("/")),
        "output_path": path,
        "record_count": observed(obs, "rows"),
        "size_mb": round(_bytes_under(spark, path) / (1024.0 * 1024.0), 2),
        "partitioned_by": list(partition_by or []),
        "compression": compression,
        "mode": mode,
        "duration_seconds": round(duration, 2),
    }


SAVE_RESULT = T.StructType(
    [
        T.StructField("dataset_name", T.StringType()),
        T.StructField("output_path", T.StringType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("size_mb", T.DoubleType()),
        T.StructField("partitioned_by", T.ArrayType(T.StringType())),
        T.StructField("compression", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)


def save_all(
    frames: dict,
    root: str,
    partitioning: dict[str, list[str]] | None = None,
    mode: str = "overwrite",
    parallel: bool = True,
    spark: SparkSession | None = None,
) -> DataFrame:
    """Write several datasets under ``root``; one failure does not stop the rest.

    ``frames`` maps names to DataFrames or to zero-argument functions that
    build one (so a frame whose construction runs a job, e.g. a checkpoint,
    is built inside its worker). The writes are independent jobs; with
    ``parallel`` they are submitted from separate driver threads so the
    cluster runs them side by side. Returns one result row per dataset (the
    error text for a failed one).
    """
    from concurrent.futures import ThreadPoolExecutor

    parts = DEFAULT_PARTITIONING if partitioning is None else partitioning
    if spark is None:
        first = next(iter(frames.values()))
        spark = first.sparkSession if isinstance(first, DataFrame) else SparkSession.active()

    def write(item):
        name, frame = item
        cols = parts.get(name, [])
        try:
            df = frame() if callable(frame) and not isinstance(frame, DataFrame) else frame
            cols = [c for c in cols if c in df.columns]
            meta = sink_parquet(df, os.path.join(root, name), cols or None, mode)
            return (*[meta[f.name] for f in SAVE_RESULT.fields[:-1]], None)
        except Exception as exc:  # noqa: BLE001 - recorded in the result row
            return (name, os.path.join(root, name), None, None, cols, None, mode, None, str(exc))

    items = list(frames.items())
    if parallel and len(items) > 1:
        with ThreadPoolExecutor(max_workers=len(items)) as pool:
            results = list(pool.map(write, items))
    else:
        results = [write(i) for i in items]
    return spark.createDataFrame(results, SAVE_RESULT)


def scan_dataset(
    spark: SparkSession, root: str, name: str, schema: T.StructType | None = None
) -> DataFrame | None:
    """A stored dataset; if absent: an empty frame of ``schema``, else None.

    A replacement that was committed and not yet moved into place is followed.
    """
    path = current_folder(spark, os.path.join(root, name))
    if _exists(spark, path):
        reader = spark.read
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(path)
    if schema is not None:
        return spark.createDataFrame([], schema)
    return None


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists (asked of its file system; no job runs)."""
    fs, at = _at(spark, path)
    return fs.exists(at)


def _bytes_under(spark: SparkSession, path: str) -> int:
    """Total bytes of the files below a path (one listing aggregate)."""
    total = _listing(spark, path).agg(F.sum("length")).first()[0]
    return int(total or 0)


def _listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", "length", "modificationTime")


def list_datasets(spark: SparkSession, root: str) -> DataFrame:
    """Names of the datasets (first-level folders holding Parquet files) under ``root``."""
    if not _exists(spark, root):
        return spark.createDataFrame([], "name string")
    marker = root.rstrip("/") + "/"
    files = _listing(spark, root, "*.parquet")
    after = F.expr(f"substring(path, locate({_sql_str(marker)}, path) + {len(marker)})")
    return files.select(F.substring_index(after, "/", 1).alias("name")).distinct()


def datasets_overview(spark: SparkSession, root: str) -> DataFrame:
    """Every dataset under ``root`` with its size (MB), Parquet file count and
    last modification: one listing, grouped by first-level folder."""
    if not _exists(spark, root):
        return spark.createDataFrame(
            [], "name string, size_mb double, file_count long, last_modified timestamp"
        )
    marker = root.rstrip("/") + "/"
    files = _listing(spark, root)
    after = F.expr(f"substring(path, locate({_sql_str(marker)}, path) + {len(marker)})")
    named = files.select(F.substring_index(after, "/", 1).alias("name"), "path", "length", "modificationTime")
    return (
        named.filter(~F.col("name").startswith("_") & ~F.col("name").startswith("."))
        .groupBy("name")
        .agg(
            F.round(F.sum("length") / (1024.0 * 1024.0), 2).alias("size_mb"),
            F.count_if(F.col("path").endswith(".parquet")).alias("file_count"),
            F.max("modificationTime").alias("last_modified"),
        )
        .filter(F.col("file_count") > 0)
    )


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def dataset_info(spark: SparkSession, path: str) -> dict:
    """Total size (MB, 2 decimals), Parquet file count and last modification."""
    if not _exists(spark, path):
        return {"name": os.path.basename(path.rstrip("/")), "path": path, "size_mb": 0.0,
                "file_count": 0, "last_modified": None}
    row = dataset_info_frame(spark, path).first()
    return row.asDict()


def dataset_info_frame(spark: SparkSession, path: str) -> DataFrame:
    """One-row frame: name, path, size_mb, file_count, last_modified."""
    files = _listing(spark, path)
    return files.agg(
        F.round(F.sum("length") / (1024.0 * 1024.0), 2).alias("size_mb"),
        F.count_if(F.col("path").endswith(".parquet")).alias("file_count"),
        F.max("modificationTime").alias("last_modified"),
    ).select(
        F.lit(os.path.basename(path.rstrip("/"))).alias("name"),
        F.lit(path).alias("path"),
        "size_mb",
        "file_count",
        "last_modified",
    )


def latest_landing(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """The newest landing under ``folder``: ``path, files, length, modificationTime``.

    Part files that one job wrote side by side are one landing, named by their
    folder; any other file is a landing of its own. Ties go to the greatest path.
    """
    listed = _listing(spark, folder, glob)
    parent = F.regexp_replace("path", "/[^/]*$", "")
    is_part = F.regexp_replace("path", "^.*/", "").startswith("part-")
    landings = (
        listed.withColumn("landing", F.when(is_part, parent).otherwise(F.col("path")))
        .groupBy("landing")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("length").alias("length"),
            F.max("modificationTime").alias("modificationTime"),
        )
    )
    newest = F.max_by(F.struct("*"), F.struct("modificationTime", "landing")).alias("l")
    return landings.agg(newest).where("l IS NOT NULL").select(
        F.col("l.landing").alias("path"), "l.files", "l.length", "l.modificationTime"
    )


def latest_file(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """Newest matching file by modification time (ties: greatest path)."""
    files = _listing(spark, folder, glob)
    return files.agg(
        F.max_by("path", F.struct("modificationTime", "path")).alias("path"),
        F.max("modificationTime").alias("modificationTime"),
    )
