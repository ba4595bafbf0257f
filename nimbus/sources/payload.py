"""Raw weather payloads: parallel arrays per location -> one row per day.

A payload holds, per location, one array of days and one array per measure.
Flattening is a narrow operation (``posexplode`` of the day array plus
positional reads of the measure arrays), so it runs inside the scan stage with
no shuffle, one document per row.

Ragged arrays: a measure array shorter than the day array yields null for the
missing days, except rain, whose missing days read as 0 (an explicit null in
the rain array stays null). Documents without a ``daily`` block or with an
empty day array produce no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbus.schema import PAYLOAD, PAYLOAD_FIELDS

# Station id prefix and station name suffix of landed rows.
STATION_PREFIX = "OPENMETEO_"
STATION_SUFFIX = ", Côte d'Azur, France"


def parse_payloads(text: DataFrame, col: str = "value") -> DataFrame:
    """JSON text column -> one struct column ``doc`` with the payload schema."""
    return text.select(F.from_json(F.col(col), PAYLOAD).alias("doc"))


def station_id(location: Column, prefix: str = STATION_PREFIX) -> Column:
    return F.concat(F.lit(prefix), F.upper(location))


def station_name(location: Column, suffix: str = STATION_SUFFIX) -> Column:
    return F.concat(location, F.lit(suffix))


def enrich_station(
    df: DataFrame,
    location_col: str = "location_name",
    prefix: str = STATION_PREFIX,
    suffix: str = STATION_SUFFIX,
) -> DataFrame:
    """STATION, STATION_NAME and the constant ELEVATION from a location name."""
    loc = F.col(location_col)
    return df.withColumns(
        {
            "STATION": station_id(loc, prefix),
            "STATION_NAME": station_name(loc, suffix),
            "ELEVATION": F.lit(0),
        }
    )


def flatten_payload(
    docs: DataFrame,
    doc_col: str = "doc",
    prefix: str = STATION_PREFIX,
    suffix: str = STATION_SUFFIX,
) -> DataFrame:
    """Documents (struct column ``doc``) -> observation rows (DATE as text)."""
    d = F.col(doc_col)
    daily = d.getField("data").getField("daily")
    exploded = docs.select(
        d.getField("location_name").alias("_loc"),
        d.getField("latitude").alias("LATITUDE"),
        d.getField("longitude").alias("LONGITUDE"),
        daily.alias("_daily"),
        F.posexplode(daily.getField("time")).alias("_i", "DATE"),
    )
    measures = {}
    for out, field in PAYLOAD_FIELDS.items():
        arr = F.col("_daily").getField(field)
        value = F.get(arr, F.col("_i"))
        if out == "PRCP":
            value = F.when(F.col("_i") < F.coalesce(F.size(arr), F.lit(0)), value).otherwise(
                F.lit(0.0)
            )
        measures[out] = value
    loc = F.col("_loc")
    return exploded.select(
        station_id(loc, prefix).alias("STATION"),
        station_name(loc, suffix).alias("STATION_NAME"),
        "DATE",
        "LATITUDE",
        "LONGITUDE",
        F.lit(0).alias("ELEVATION"),
        *[measures[c].alias(c) for c in ("TMAX", "TMIN", "TAVG", "PRCP", "AWND", "RHUM")],
    )


def build_payloads(station_day: DataFrame, fetched_at: str = "1970-01-01T00:00:00") -> DataFrame:
    """Payload documents (JSON text) from per-(station, day) rows.

    One document per station and calendar year. Rows are first reduced to one
    per station and day here, so a document never holds more than 366 days
    whatever the caller passes; days are ordered inside the document and the
    measure arrays stay aligned with the day array (nulls included, since
    whole day records are collected).
    """
    rec = F.struct(
        F.col("DATE").cast("string").alias("t"),
        *[F.col(c).alias(c) for c in PAYLOAD_FIELDS],
    )
    station = ["STATION"] if "STATION" in station_day.columns else []
    one_a_day = station_day.groupBy(*station, "STATION_NAME", "DATE").agg(F.max(rec).alias("_day"))
    grouped = one_a_day.groupBy(
        *station, F.col("STATION_NAME").alias("location_name"), F.year("DATE").alias("_yr")
    ).agg(F.sort_array(F.collect_list("_day")).alias("_days"))

    def field_of(name: str):
        return lambda r: r[name]

    daily = F.struct(
        F.transform("_days", field_of("t")).alias("time"),
        *[F.transform("_days", field_of(c)).alias(f) for c, f in PAYLOAD_FIELDS.items()],
    )
    doc = F.struct(
        F.col("location_name"),
        F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"),
        F.lit(fetched_at).alias("fetch_timestamp"),
        F.struct(daily.alias("daily")).alias("data"),
    )
    return grouped.select(
        "location_name", F.col("_yr").alias("YEAR"), F.to_json(doc).alias("value")
    )
