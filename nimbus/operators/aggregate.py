"""Daily, monthly, seasonal and yearly aggregates from one pass of day states.

``day_states`` folds the observation rows once, by DATE: counts, sums, extremes
and spreads of every measure, and the least station. States can be merged, so
every coarser level (and the aggregation facts of the ledger) is rolled up from
the few thousand days, not from the rows again. ``OUTPUTS`` says which measure
and statistic each output shows, ``LEVELS`` which outputs a level keeps.

Rows are folded by a hash aggregate with a map-side partial step: a day that
holds a third of all rows is one row per task in the exchange. Spark folds
minima of strings only by sorting, so stations are first replaced by ordered
codes (``station_codes``: a small stored table), the least code is taken, and
the days are decoded. Without codes the least string is taken directly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbus.functions.calendar import season
from nimbus.session import cut_lineage

MEASURES = ("TAVG", "RHUM", "PRCP", "AWND")
STATIONS = ("STATION", "STATION_NAME")
ROWS = "N_ROWS"

# parts of a state -> how the part of a day is folded from rows; "SD" is merged by the ledger alone
PARTS: dict[str, Callable[[str], Column]] = {"N": F.count, "SUM": F.sum, "LO": F.min, "HI": F.max, "SD": F.stddev_samp}
MERGED: dict[str, Callable[[str], Column]] = {"N": F.sum, "SUM": F.sum, "LO": F.min, "HI": F.max}


def part(measure: str, name: str) -> str:
    """Column name of a part of a measure's state."""
    return f"{measure}_{name}"


def mean_of(measure: str) -> Column:
    return F.try_divide(F.col(part(measure, "SUM")), F.col(part(measure, "N")))


# Output column -> (observation column, statistic).
OUTPUTS: dict[str, tuple[str, str]] = {
    "TEMP_AVG": ("TAVG", "MEAN"),
    "TEMP_MIN": ("TAVG", "LO"),
    "TEMP_MAX": ("TAVG", "HI"),
    "TEMP_STD": ("TAVG", "SD"),
    "HUMIDITY_AVG": ("RHUM", "MEAN"),
    "HUMIDITY_MIN": ("RHUM", "LO"),
    "HUMIDITY_MAX": ("RHUM", "HI"),
    "PRECIPITATION_TOTAL": ("PRCP", "SUM"),
    "PRECIPITATION_AVG": ("PRCP", "MEAN"),
    "PRECIPITATION_MAX": ("PRCP", "HI"),
    "WIND_SPEED_AVG": ("AWND", "MEAN"),
    "WIND_SPEED_MAX": ("AWND", "HI"),
}


@dataclass(frozen=True)
class Level:
    """Grouping keys, the name of the row count, and the outputs left out."""

    keys: tuple[str, ...]
    count: str
    without: frozenset[str] = frozenset()


_SPREADS = frozenset({"TEMP_STD", "HUMIDITY_MIN", "HUMIDITY_MAX", "PRECIPITATION_MAX", "WIND_SPEED_MAX"})
LEVELS = {
    "daily": Level(("DATE",), "RECORDS_COUNT"),
    "monthly": Level(("YEAR", "MONTH"), "DAYS_COUNT", _SPREADS),
    "seasonal": Level(("YEAR", "SEASON"), "DAYS_COUNT", _SPREADS | {"HUMIDITY_AVG", "PRECIPITATION_AVG", "WIND_SPEED_AVG"}),
    "yearly": Level(("YEAR",), "DAYS_COUNT", _SPREADS),
}


# ------------------------------------------------------------------ stations


def station_codes(rows: DataFrame) -> DataFrame:
    """`name, code` of every station id and name: a small stored table whose codes rise with the names.

    Codes are partition numbers and places of a range-partitioned sort, so no
    task sees all names, and the stored table is what rows and days both use.
    """
    there = [c for c in STATIONS if c in rows.columns]
    names = rows.select(F.explode(F.array(*there)).alias("name")).where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(names.select("name").orderBy("name").withColumn("code", F.monotonically_increasing_id()), "station-codes")


def encoded(rows: DataFrame, codes: DataFrame, columns: tuple[str, ...] = STATIONS) -> DataFrame:
    """The station columns as codes. Spark broadcasts the stored codes while their size is below its threshold."""
    for c in columns:
        rows = rows.join(codes.select(F.col("name").alias(c), F.col("code").alias(f"_{c}")), c, "left").drop(c).withColumnRenamed(f"_{c}", c)
    return rows


def decoded(rows: DataFrame, codes: DataFrame, columns: tuple[str, ...] = STATIONS) -> DataFrame:
    """Codes back as names; the order of the columns is kept."""
    out = rows
    for c in columns:
        out = out.join(codes.select(F.col("code").alias(c), F.col("name").alias(f"_{c}")), c, "left").drop(c).withColumnRenamed(f"_{c}", c)
    return out.select(*rows.columns)


# -------------------------------------------------------------------- states


def day_states(rows: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """One mergeable row per DATE (and one for all rows without a date); measures of absent columns are absent."""
    there = [m for m in MEASURES if m in rows.columns]
    slim = rows.select("DATE", *STATIONS, *there)
    parts = [how(m).alias(part(m, name)) for m in there for name, how in PARTS.items()]
    least = [F.min(c).alias(c) for c in STATIONS]
    folded = (slim if codes is None else encoded(slim, codes)).groupBy("DATE").agg(*least, *parts, F.count(F.lit(1)).alias(ROWS))
    return folded if codes is None else decoded(folded, codes)


def is_states(frame: DataFrame) -> bool:
    return ROWS in frame.columns


def _states(frame: DataFrame, codes: DataFrame | None) -> DataFrame:
    """Observation rows are folded; day states are taken as they are."""
    return frame if is_states(frame) else day_states(frame, codes)


def _outputs(states: DataFrame, level: Level) -> list[Column]:
    there = set(states.columns)
    shown = [
        (mean_of(m) if stat == "MEAN" else F.col(part(m, stat))).alias(out)
        for out, (m, stat) in OUTPUTS.items()
        if out not in level.without and part(m, "N") in there
    ]
    return [F.col(c) for c in STATIONS] + shown + [F.col(ROWS).alias(level.count)]


def _with_calendar(states: DataFrame) -> DataFrame:
    date = F.col("DATE")
    return states.withColumns({"YEAR": F.year(date), "MONTH": F.month(date), "DAY": F.dayofmonth(date), "SEASON": season(F.month(date))})


def at_level(frame: DataFrame, name: str, codes: DataFrame | None = None) -> DataFrame:
    """One row for each key of the level, from observation rows or day states; outputs of absent columns are absent."""
    level, states = LEVELS[name], _states(frame, codes)
    parts = [how(c).alias(c) for m in MEASURES for p, how in MERGED.items() if (c := part(m, p)) in states.columns]
    least = [F.min(c).alias(c) for c in STATIONS]
    merged = _with_calendar(states).groupBy(*level.keys).agg(*least, *parts, F.sum(ROWS).alias(ROWS))
    return merged.select(*level.keys, *_outputs(merged, level))


def daily(frame: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """One row per DATE over all stations, with the calendar parts of the date."""
    states = _with_calendar(_states(frame, codes))
    stations, outputs = len(STATIONS), _outputs(states, LEVELS["daily"])
    return states.select("DATE", *outputs[:stations], "YEAR", "MONTH", "DAY", "SEASON", *outputs[stations:])


def monthly(frame: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """One row per (YEAR, MONTH); DAYS_COUNT counts observation rows."""
    return at_level(frame, "monthly", codes)


def seasonal(frame: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """One row per (YEAR, SEASON); December counts with its own year."""
    return at_level(frame, "seasonal", codes)


def yearly(frame: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """One row per YEAR (the YEARLY aggregation type of the ledger)."""
    return at_level(frame, "yearly", codes)


# -------------------------------------------------------------------- counts


def level_counts(days: DataFrame) -> DataFrame:
    """(DATASET, RECORDS) of the cleaned rows and of every frame made from them, out of `DATE, N_ROWS` alone.

    One row per day is folded; nothing is written to be counted.
    """
    date = F.col("DATE")
    dates = F.count(F.lit(1)).alias("daily")
    rows = F.coalesce(F.sum(ROWS), F.lit(0)).alias("clean")
    keys = {"monthly": F.struct(F.year(date), F.month(date)), "seasonal": F.struct(F.year(date), season(F.month(date)))}
    distinct = [F.size(F.collect_set(k)).cast("long").alias(n) for n, k in keys.items()]  # a few a year
    one = days.agg(rows, dates, *distinct, F.count(date).alias("trends"))
    names = {"clean": "clean", "enriched": "clean", "daily": "daily", "monthly": "monthly", "seasonal": "seasonal", "trends": "trends"}
    pairs = [F.struct(F.lit(n).alias("DATASET"), F.col(c).alias("RECORDS")) for n, c in names.items()]
    return one.select(F.explode(F.array(*pairs)).alias("x")).select("x.DATASET", "x.RECORDS")


def dataset_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(DATASET, RECORDS) per named frame, as one union of global counts."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("RECORDS")).select(F.lit(name).alias("DATASET"), "RECORDS")
        for name, df in frames.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
