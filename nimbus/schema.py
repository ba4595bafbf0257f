"""Declared schemas and column roles.

Types are declared rather than inferred: inference of a CSV ``DATE`` column
flips between date and string as soon as one value is malformed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Observation row as landed by ingestion (one row per station and day).
OBSERVATION = T.StructType(
    [
        T.StructField("STATION", T.StringType()),
        T.StructField("STATION_NAME", T.StringType()),
        T.StructField("DATE", T.StringType()),
        T.StructField("LATITUDE", T.DoubleType()),
        T.StructField("LONGITUDE", T.DoubleType()),
        T.StructField("ELEVATION", T.IntegerType()),
        T.StructField("TMAX", T.DoubleType()),
        T.StructField("TMIN", T.DoubleType()),
        T.StructField("TAVG", T.DoubleType()),
        T.StructField("PRCP", T.DoubleType()),
        T.StructField("AWND", T.DoubleType()),
        T.StructField("RHUM", T.DoubleType()),
    ]
)

# Measure columns and the raw-payload array each one is read from.
# Field names of the weather archive's daily payload.
PAYLOAD_FIELDS = {
    "TMAX": "temperature_2m_max",
    "TMIN": "temperature_2m_min",
    "TAVG": "temperature_2m_mean",
    "PRCP": "precipitation_sum",
    "AWND": "windspeed_10m_max",
    "RHUM": "relative_humidity_2m_mean",
}

PAYLOAD = T.StructType(
    [
        T.StructField("location_name", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("fetch_timestamp", T.StringType()),
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField(
                        "daily",
                        T.StructType(
                            [T.StructField("time", T.ArrayType(T.StringType()))]
                            + [
                                T.StructField(name, T.ArrayType(T.DoubleType()))
                                for name in PAYLOAD_FIELDS.values()
                            ]
                        ),
                    )
                ]
            ),
        ),
    ]
)


@dataclass(frozen=True)
class ValidationRules:
    """Plausibility bounds applied by the cleaning step.

    Fixed values: the defaults are the reference configuration's bounds.
    """

    temperature_min: float = -60.0
    temperature_max: float = 60.0
    humidity_min: float = 0.0
    humidity_max: float = 100.0
    precipitation_min: float = 0.0
    wind_speed_min: float = 0.0


DEFAULT_RULES = ValidationRules()

# Ledger tables (run metadata kept as Spark tables).
INGESTION_LEDGER = T.StructType(
    [
        T.StructField("ingestion_id", T.StringType()),
        T.StructField("ingestion_timestamp", T.TimestampNTZType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("records_count", T.LongType()),
        T.StructField("records_valid", T.LongType()),
        T.StructField("records_invalid", T.LongType()),
        T.StructField("file_size_mb", T.DecimalType(10, 2)),
        T.StructField("processing_duration_seconds", T.DecimalType(10, 2)),
        T.StructField("data_quality_score", T.DecimalType(5, 2)),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("data_start_date", T.DateType()),
        T.StructField("data_end_date", T.DateType()),
        T.StructField("additional_info", T.StringType()),
    ]
)

TRANSFORMATION_LEDGER = T.StructType(
    [
        T.StructField("transformation_id", T.StringType()),
        T.StructField("ingestion_id", T.StringType()),
        T.StructField("transformation_name", T.StringType()),
        T.StructField("transformation_type", T.StringType()),
        T.StructField("input_records", T.LongType()),
        T.StructField("output_records", T.LongType()),
        T.StructField("records_dropped", T.LongType()),
        T.StructField("processing_time_seconds", T.DecimalType(10, 2)),
        T.StructField("config", T.StringType()),
        T.StructField("output_path", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("completed_at", T.TimestampNTZType()),
    ]
)

# Allowed values of the ledger's checked columns.
SOURCE_TYPES = ("CSV", "API", "JSON", "OTHER")
INGESTION_STATUSES = ("PENDING", "SUCCESS", "FAILED", "PARTIAL")
TRANSFORMATION_STATUSES = ("PENDING", "RUNNING", "SUCCESS", "FAILED")
AGGREGATION_TYPES = ("DAILY", "MONTHLY", "SEASONAL", "YEARLY", "CUSTOM")
