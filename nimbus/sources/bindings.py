"""Views that give the driver's test tables the shapes the engine consumes.

``obs_raw`` turns every ``lineitem`` row into a weather-shaped observation
(five stations, shipping day as observation day). The ``% k`` tests below do
not select a subset: they decide which rows get a null, a malformed date or an
out-of-range value, and which rows are landed twice, so that every cleaning
rule has work to do. All rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, as scanned."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(x: Column) -> Column:
    return x.cast("string")


def obs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation rows (STATION, STATION_NAME, DATE string, 6 measures)."""
    li = table(spark, sf_dir, "lineitem")
    ok, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    ln = F.col("l_linenumber")
    qty, tax, disc = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    tax100 = F.round(tax * 100.0, 0)
    disc100 = F.round(disc * 100.0, 0)
    null_d = F.lit(None).cast("double")
    base = li.select(
        F.concat(F.lit("ST_"), _s(sk % 5)).alias("STATION"),
        F.concat(F.lit("Station "), _s(sk % 5)).alias("STATION_NAME"),
        F.when(ok % 97 == 0, F.lit(None).cast("string"))
        .when(ok % 101 == 0, F.lit("not-a-date"))
        .otherwise(_s(F.col("l_shipdate").cast("date")))
        .alias("DATE"),
        F.when(ln == 7, null_d)
        .when(pk % 211 == 0, F.lit(75.0))
        .otherwise(qty - 10.0)
        .alias("TAVG"),
        F.when(ln == 7, null_d).otherwise(qty - 10.0 + tax100).alias("TMAX"),
        F.when(ln == 7, null_d).otherwise(qty - 10.0 - disc100).alias("TMIN"),
        F.when(pk % 17 == 0, null_d)
        .when(pk % 223 == 0, F.lit(-1.0))
        .otherwise(disc100 * tax100)
        .alias("PRCP"),
        (pk % 103).cast("double").alias("RHUM"),
        ((ok % 50).cast("double") - 1.0).alias("AWND"),
        ok.alias("_ok"),
    )
    cols = ["STATION", "STATION_NAME", "DATE", "TAVG", "TMAX", "TMIN", "PRCP", "RHUM", "AWND"]
    # rows of every 31st order are landed twice: one scan, each row repeated
    # one or two times (no second scan of lineitem)
    copies = F.when(F.col("_ok") % 31 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return base.select(*cols, F.explode(copies).alias("_copy")).drop("_copy")


def ledger_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingestion ledger rows derived from ``orders`` (one run per order)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.when(F.col("o_orderpriority") == "1-URGENT", "CSV")
        .when(F.col("o_orderpriority") == "2-HIGH", "API")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "JSON")
        .otherwise("OTHER")
        .alias("source_type"),
        F.when(F.col("o_orderstatus") == "F", "SUCCESS")
        .when(F.col("o_orderstatus") == "O", "PENDING")
        .otherwise("FAILED")
        .alias("status"),
        F.col("o_custkey").alias("records_count"),
        (F.col("o_orderkey") % 101).cast("double").alias("data_quality_score"),
        F.col("o_orderdate").alias("ingestion_timestamp"),
    )


def transformation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transformation ledger rows derived from ``orders``.

    Customer keys above 499 give ``input_records = 0`` and, for keys above
    399, ``output_records > input_records``: the constraint checks see both.
    """
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("transformation_name"),
        F.col("o_orderstatus").alias("transformation_type"),
        (F.col("o_custkey") % 500).alias("input_records"),
        (F.col("o_custkey") % 400).alias("output_records"),
        ((F.col("o_orderkey") % 997).cast("double") / 100.0).alias("processing_time_seconds"),
        F.when(F.col("o_orderstatus") == "F", "SUCCESS")
        .when(F.col("o_orderstatus") == "O", "RUNNING")
        .otherwise("FAILED")
        .alias("status"),
    )
