"""Moving averages over row frames, and temperature trend slopes.

A row frame ("this row and the k-1 before it, in DATE order") over a frame
without partition keys would normally run in a single task
(``Exchange SinglePartition``). Here the rows are range-partitioned in their
order into consecutive spans (``spans``); the last ``w-1`` rows before a span
are handed to it as a read-only halo, and the window runs partitioned by (key,
span), so each task holds a span and its halo. Halo rows are dropped afterwards.

A frame that must stay lazy (``lazy``, nothing runs before an action) is cut into
blocks of equal numbers of rows instead, by positions from joined year counts:
more scans and shuffles in one plan.

The result equals the plain ``Window.orderBy(DATE).rowsBetween(-(w-1), 0)``
frame on input that is unique on (key, DATE); gaps in the calendar widen the
span of a frame, as rows (not days) are counted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbus.operators.spans import SPAN, spanned
from nimbus.session import cut_lineage

# name -> (source column, frame width in rows) of the daily trend columns
DAILY_SPECS = {
    "TEMP_MA_7D": ("TEMP_AVG", 7),
    "TEMP_MA_30D": ("TEMP_AVG", 30),
    "PRCP_MA_7D": ("PRECIPITATION_TOTAL", 7),
}

STATION_SPECS = {
    "TEMP_MA_7D": ("TAVG", 7),
    "TEMP_MA_30D": ("TAVG", 30),
    "PRCP_MA_7D": ("PRCP", 7),
}


def row_positions(
    df: DataFrame, order_col: str = "DATE", keys: Sequence[str] = ()
) -> DataFrame:
    """Add ``_pos`` (0-based position in ``order_col`` order within ``keys``)."""
    keys = list(keys)
    base = df.withColumn("_yr", F.year(F.col(order_col)))
    counts = base.groupBy(*keys, "_yr").agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        before = Window.partitionBy(*keys).orderBy("_yr").rowsBetween(
            Window.unboundedPreceding, -1
        )
        offsets = counts.select(
            *keys, "_yr", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
        )
    else:
        # prefix sum over the per-year counts without a single-partition
        # window: each year's count is added to every later year up to the
        # last year (years^2 / 2 rows at most, a calendar-sized table)
        last = counts.agg(F.max("_yr")).scalar()
        fanned = counts.select(
            F.explode(F.sequence(F.col("_yr") + 1, F.greatest(last, F.col("_yr") + 1))).alias("_yr"),
            F.when(F.col("_yr") < last, F.col("_n")).otherwise(F.lit(0)).alias("_n"),
        )
        later = fanned.groupBy("_yr").agg(F.sum("_n").alias("_off"))
        offsets = counts.join(later, "_yr", "left").select(
            "_yr", F.coalesce(F.col("_off"), F.lit(0)).alias("_off")
        )
    inside = Window.partitionBy(*keys, "_yr").orderBy(order_col)
    ranked = base.withColumn("_rn", F.row_number().over(inside))
    return (
        ranked.join(offsets, [*keys, "_yr"])
        .withColumn("_pos", F.col("_off") + F.col("_rn") - 1)
        .drop("_yr", "_rn", "_off")
    )


def _heirs(sizes: Sequence[int], halo: int) -> dict[int, list[int]]:
    """For every span the later spans that need some of its last ``halo`` rows: the next one, and those after it
    while the spans in between hold fewer rows than the halo together."""
    out: dict[int, list[int]] = {}
    for i in range(len(sizes)):
        between = 0
        out[i] = []
        for j in range(i + 1, len(sizes)):
            if between >= halo:
                break
            out[i].append(j)
            between += sizes[j]
    return out


def _in_spans(df: DataFrame, order: list[str], halo: int, rows: int) -> DataFrame:
    """Rows with their span, and the rows before each span once more as its halo."""
    own, sizes = spanned(df, [F.col(c) for c in order], rows)
    last = Window.partitionBy(SPAN).orderBy(*[F.col(c).desc() for c in order])
    ends = own.withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") <= halo).drop("_rn")
    heirs = [(i, j) for i, to in _heirs(sizes, halo).items() for j in to]  # about one row for each span
    to = df.sparkSession.createDataFrame(heirs, f"{SPAN} int, _to int")
    handed = ends.join(F.broadcast(to), SPAN).drop(SPAN).withColumnRenamed("_to", SPAN)
    return own.withColumn("_halo", F.lit(False)).unionByName(handed.withColumn("_halo", F.lit(True)))


def _in_blocks(df: DataFrame, order_col: str, keys: list[str], halo: int, rows: int) -> DataFrame:
    """The same by positions, without a job of its own."""
    block = max(rows, halo + 1)
    pos = row_positions(df, order_col, keys).withColumn(SPAN, F.floor(F.col("_pos") / block))
    copies = pos.filter(F.col("_pos") % block >= block - halo).withColumn(SPAN, F.col(SPAN) + 1)
    return pos.withColumn("_halo", F.lit(False)).unionByName(copies.withColumn("_halo", F.lit(True)))


def moving_averages(
    df: DataFrame,
    specs: Mapping[str, tuple[str, int]],
    order_col: str = "DATE",
    keys: Sequence[str] = (),
    block_rows: int = 100_000,
    materialize: bool = True,
    lazy: bool = False,
) -> DataFrame:
    """Append one moving-average column per spec (rows frame, nulls skipped).

    ``df`` must be unique on (keys, order_col) with a non-null order column.
    A span holds about ``block_rows`` rows. The input is read more than once,
    so unless ``materialize`` is off (input already read from storage, or
    ``lazy``) it is written once first.
    """
    specs = {n: (c, w) for n, (c, w) in specs.items() if c in df.columns}
    if not specs:
        return df
    keys, halo = list(keys), max(w for _, w in specs.values()) - 1
    if lazy:
        both = _in_blocks(df, order_col, keys, halo, block_rows)
    else:
        both = _in_spans(cut_lineage(df) if materialize else df, [*keys, order_col], halo, block_rows)
    w = Window.partitionBy(*keys, SPAN).orderBy(order_col)
    avgs: dict[str, Column] = {
        name: F.avg(src).over(w.rowsBetween(-(width - 1), 0))
        for name, (src, width) in specs.items()
    }
    out = both.withColumns(avgs).filter(~F.col("_halo"))
    return out.select(*df.columns, *avgs.keys())


def trends(
    daily: DataFrame,
    specs: Mapping[str, tuple[str, int]] = DAILY_SPECS,
    materialize: bool = True,
    lazy: bool = False,
) -> DataFrame:
    """Daily frame (dated rows only) plus its 7/30-row temperature and 7-row rain averages."""
    dated = daily.filter(F.col("DATE").isNotNull())
    return moving_averages(dated, specs, "DATE", materialize=materialize, lazy=lazy)


def station_trends(
    rows: DataFrame,
    specs: Mapping[str, tuple[str, int]] = STATION_SPECS,
    materialize: bool = True,
) -> DataFrame:
    """Per-station moving averages on observation rows.

    Rows are first reduced to one per (STATION, DATE) (mean temperature, total
    rain) so frames are unambiguous, then averaged per station.
    """
    per_day = (
        rows.filter(F.col("DATE").isNotNull())
        .groupBy("STATION", "DATE")
        .agg(F.avg("TAVG").alias("TAVG"), F.sum("PRCP").alias("PRCP"))
    )
    return moving_averages(per_day, specs, "DATE", keys=["STATION"], materialize=materialize)


def trend_slope(daily: DataFrame, col: str = "TEMP_AVG", digits: int = 9) -> DataFrame:
    """Least-squares slope of a daily measure per day, with its direction."""
    x = F.unix_date(F.col("DATE")).cast("double")
    slope = F.regr_slope(F.col(col), x)
    out = daily.filter(F.col("DATE").isNotNull()).agg(
        F.round(slope, digits).alias("SLOPE_PER_DAY"),
        F.round(slope * 365.25, 6).alias("SLOPE_PER_YEAR"),
        F.count(F.col(col)).alias("N_DAYS"),
    )
    return out.withColumn(
        "DIRECTION",
        F.when(F.col("SLOPE_PER_DAY") > 0, "rising")
        .when(F.col("SLOPE_PER_DAY") < 0, "falling")
        .when(F.col("SLOPE_PER_DAY") == 0, "flat"),
    )


def station_slopes(rows: DataFrame, col: str = "TAVG", digits: int = 9) -> DataFrame:
    """Per-station slope of the measure against the day number."""
    x = F.unix_date(F.col("DATE")).cast("double")
    slope = F.regr_slope(F.col(col), x)
    return (
        rows.filter(F.col("DATE").isNotNull())
        .groupBy("STATION")
        .agg(
            F.round(slope, digits).alias("SLOPE_PER_DAY"),
            F.round(F.regr_r2(F.col(col), x), 6).alias("R2"),
            F.count(F.col(col)).alias("N_OBS"),
        )
        .withColumn(
            "DIRECTION",
            F.when(F.col("SLOPE_PER_DAY") > 0, "rising")
            .when(F.col("SLOPE_PER_DAY") < 0, "falling")
            .when(F.col("SLOPE_PER_DAY") == 0, "flat"),
        )
    )
