"""Run ledger kept as Spark tables: records, summaries, constraint checks,
aggregation facts and data-quality checks.

Ledger tables are plain Parquet folders appended with Spark's writer; the
summaries are grouped aggregates over them.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbus.functions.calendar import SEASONS, season_index
from nimbus.operators import aggregate
from nimbus.schema import (
    AGGREGATION_TYPES,
    DEFAULT_RULES,
    INGESTION_LEDGER,
    INGESTION_STATUSES,
    SOURCE_TYPES,
    TRANSFORMATION_LEDGER,
    TRANSFORMATION_STATUSES,
    ValidationRules,
)
from nimbus.session import cut_lineage
from nimbus.sources import files


# ---------------------------------------------------------------- records


def _dec(x, digits=2):
    from decimal import Decimal

    return None if x is None else Decimal(str(round(float(x), digits)))


def record_ingestion(
    spark: SparkSession,
    path: str,
    source_type: str,
    source_name: str,
    records_count: int = 0,
    records_valid: int = 0,
    records_invalid: int = 0,
    status: str = "SUCCESS",
    duration_seconds: float | None = None,
    quality_score: float | None = None,
    file_size_mb: float | None = None,
    start_date: dt.date | None = None,
    end_date: dt.date | None = None,
    details: dict | None = None,
    source_path: str | None = None,
    error_message: str | None = None,
    ingestion_id: str | None = None,
) -> DataFrame:
    """Append one ingestion row (checked first) and return it."""
    row = (
        ingestion_id or str(uuid.uuid4()),
        dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
        source_type,
        source_name,
        source_path,
        int(records_count),
        int(records_valid),
        int(records_invalid),
        _dec(file_size_mb),
        _dec(duration_seconds),
        _dec(quality_score),
        status,
        error_message,
        start_date,
        end_date,
        json.dumps(details or {}, default=str, sort_keys=True),
    )
    df = spark.createDataFrame([row], INGESTION_LEDGER)
    append_checked(df, path, "ingestion")
    return df


def append_ingestions(runs: DataFrame, path: str) -> DataFrame:
    """Append many ingestion rows (any subset of the ledger columns) at once.

    Missing columns become null, ids are generated per row on the executors,
    and the rows are checked against the ledger constraints before the append.
    """
    present = set(runs.columns)
    cols = []
    for f in INGESTION_LEDGER.fields:
        if f.name == "ingestion_id" and f.name not in present:
            cols.append(F.expr("uuid()").alias(f.name))
        elif f.name in present:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    # written once: what is checked is what is appended
    rows = cut_lineage(runs.select(*cols), "ledger-rows")
    append_checked(rows, path, "ingestion")
    return rows


def record_transformation(spark: SparkSession, path: str, name: str, input_records: int, output_records: int, **more) -> DataFrame:
    """Append one transformation row; records_dropped = max(in - out, 0). ``more`` as in ``transformation_row``."""
    return record_transformations(spark, path, [transformation_row(name, input_records, output_records, **more)])


def record_transformations(spark: SparkSession, path: str, rows: list[tuple]) -> DataFrame:
    """Append several transformation rows with one check and one write."""
    df = spark.createDataFrame(rows, TRANSFORMATION_LEDGER)
    append_checked(df, path, "transformation")
    return df


def append_transformations(runs: DataFrame, path: str) -> DataFrame:
    """Append many transformation rows (any subset of the ledger columns) at once, checked first."""
    dropped = with_records_dropped(runs)
    present = set(dropped.columns)
    cols = [
        (F.col(f.name).cast(f.dataType) if f.name in present else F.expr("uuid()") if f.name == "transformation_id" else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in TRANSFORMATION_LEDGER.fields
    ]
    rows = cut_lineage(dropped.select(*cols), "ledger-rows")
    append_checked(rows, path, "transformation")
    return rows


def transformation_id(ingestion_id: str | None, name: str) -> str:
    return str(uuid.uuid4() if ingestion_id is None else uuid.uuid5(uuid.NAMESPACE_OID, f"{ingestion_id}/{name}"))


def transformation_row(
    name: str,
    input_records: int | None,
    output_records: int | None,
    processing_time: float | None = None,
    output_path: str | None = None,
    config: dict | None = None,
    ingestion_id: str | None = None,
    kind: str = "AGGREGATION",
    status: str = "SUCCESS",
    error_message: str | None = None,
) -> tuple:
    """One ledger row; it completed now and started ``processing_time`` seconds ago.

    The steps of a named run have ids that follow from the run and the step, so a retry writes the same ones.
    """
    done = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    known = input_records is not None and output_records is not None
    return (
        transformation_id(ingestion_id, name),
        ingestion_id,
        name,
        kind,
        input_records,
        output_records,
        max(input_records - output_records, 0) if known else None,
        _dec(processing_time),
        json.dumps(config or {}, default=str, sort_keys=True),
        output_path,
        status,
        error_message,
        done - dt.timedelta(seconds=processing_time or 0),
        done,
    )


def with_records_dropped(runs: DataFrame) -> DataFrame:
    """Add ``records_dropped = greatest(input - output, 0)``."""
    return runs.withColumn(
        "records_dropped",
        F.greatest(F.col("input_records") - F.col("output_records"), F.lit(0)).cast("long"),
    )


# -------------------------------------------------------------- summaries


def _ingestion_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_ingestions"),
        F.sum("records_count").alias("total_records"),
        F.avg("data_quality_score").alias("avg_quality_score"),
    ]


def ingestion_stats(ledger: DataFrame) -> DataFrame:
    """Per source type: runs, records, mean quality score, latest run."""
    latest = F.max("ingestion_timestamp").alias("last_ingestion")
    return ledger.groupBy("source_type").agg(*_ingestion_counts(), latest)


def ingestion_summary(ledger: DataFrame) -> DataFrame:
    """Ingestion stats plus successful and failed run counts."""
    having = lambda status: F.count_if(F.col("status") == status)
    return ledger.groupBy("source_type").agg(
        *_ingestion_counts(),
        having("SUCCESS").alias("successful_ingestions"),
        having("FAILED").alias("failed_ingestions"),
        F.max("ingestion_timestamp").alias("last_ingestion"),
    )


def transformation_performance(runs: DataFrame, digits: int = 6) -> DataFrame:
    """Per (name, type): runs, mean time, mean output/input % (null input ignored)."""
    ratio = F.try_divide(
        F.col("output_records").cast("double"), F.nullif(F.col("input_records"), F.lit(0))
    ) * 100.0
    return runs.groupBy("transformation_name", "transformation_type").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.round(F.avg("processing_time_seconds"), digits).alias("avg_processing_time"),
        F.round(F.avg(ratio), digits).alias("avg_retention_rate"),
        F.sum(F.when(F.col("status") == "SUCCESS", 1).otherwise(0)).alias("successful_runs"),
    )


# ------------------------------------------------------------ constraints


def _violations(kind: str) -> list[tuple[str, tuple[str, ...], Column]]:
    """(rule, the columns that it reads, condition of a broken row) of a ledger table."""

    def allowed(column: str, values: tuple[str, ...]) -> tuple[str, tuple[str, ...], Column]:
        c = F.col(column)
        return column, (column,), c.isNull() | ~c.isin(*values)

    score = F.col("data_quality_score")
    rules = {
        "ingestion": lambda: [
            allowed("source_type", SOURCE_TYPES),
            allowed("status", INGESTION_STATUSES),
            ("quality_score", ("data_quality_score",), ~score.between(0, 100)),
        ],
        "transformation": lambda: [
            allowed("status", TRANSFORMATION_STATUSES),
            ("output_exceeds_input", ("input_records", "output_records"), F.col("output_records") > F.col("input_records")),
        ],
        "aggregation": lambda: [allowed("aggregation_type", AGGREGATION_TYPES)],
    }
    if kind not in rules:
        raise ValueError(f"unknown ledger kind {kind!r}")
    return rules[kind]()


def ledger_constraints(df: DataFrame, kind: str) -> DataFrame:
    """Rows that break a ledger constraint, with the names of the broken rules.

    A rule over a column that the table does not have does not apply.
    """
    there = set(df.columns)
    rules = [(n, c) for n, reads, c in _violations(kind) if there.issuperset(reads)]
    broken = F.array_compact(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules])
    )
    return df.withColumn("violations", broken).filter(F.size("violations") > 0)


# The column that names a row of a ledger table.
ROW_IDS = {"ingestion": "ingestion_id", "transformation": "transformation_id"}


def append_checked(df: DataFrame, path: str, kind: str) -> None:
    """Add rows to a ledger table after checking its constraints; a row with an id that is there replaces it.

    A retried run that gives its rows the same ids therefore leaves one row each.
    """
    bad = ledger_constraints(df, kind).limit(1).count()
    if bad:
        raise ValueError(f"{kind} ledger rows violate a constraint")
    key = ROW_IDS.get(kind)
    if key is not None:
        n, ids = df.agg(F.count(key), F.countDistinct(key)).first()
        if n != ids:
            raise ValueError(f"{kind} ledger rows share an id")
    _put(df, path, key)


def put_run(df: DataFrame, path: str, run_id: str | None, key: str = "ingestion_id") -> None:
    """Add the rows of one run; rows that an earlier try of the run left are replaced. Without an id they are appended."""
    _put(df.withColumn(key, F.lit(run_id).cast("string")), path, None if run_id is None else key, run_id)


def _put(df: DataFrame, path: str, key: str | None, run_id: str | None = None) -> None:
    spark = df.sparkSession
    files.settle(spark, path)
    if key is not None and files._exists(spark, path):
        old = spark.read.parquet(path)
        ids = df.select(key) if run_id is None else spark.createDataFrame([(run_id,)], f"{key} string")
        if old.join(ids, key, "left_semi").limit(1).count():
            kept = old.join(ids, key, "left_anti")
            files.replace_dataset(spark, path, kept.unionByName(df, allowMissingColumns=True).write.parquet)
            return
    df.write.mode("append").parquet(path)


# --------------------------------------------------------- aggregation facts

# Measure column -> metric name in the aggregation facts.
METRICS = {"TAVG": "temperature", "RHUM": "humidity", "PRCP": "precipitation", "AWND": "wind_speed"}


# Aggregation type -> the step of a batch run whose periods it describes.
FACT_STEPS = {"DAILY": "daily", "MONTHLY": "monthly", "SEASONAL": "seasonal", "YEARLY": "daily"}


def _day_metrics(states: DataFrame, measures: list[str]) -> DataFrame:
    """Per DATE and metric number: count, sum, least, most, and the squares about the day's mean."""
    sd, n = (lambda c: F.coalesce(F.col(aggregate.part(c, "SD")), F.lit(0.0))), (lambda c: F.col(aggregate.part(c, "N")))
    structs = [
        F.struct(
            F.lit(i).alias("m"), n(c).alias("n"), F.col(aggregate.part(c, "SUM")).alias("s"), F.col(aggregate.part(c, "LO")).alias("lo"),
            F.col(aggregate.part(c, "HI")).alias("hi"), (sd(c) * sd(c) * (n(c) - 1)).alias("sq"),
        )
        for i, c in enumerate(measures)
    ]
    return states.filter(F.col("DATE").isNotNull()).select("DATE", F.explode(F.array(*structs)).alias("x")).select("DATE", "x.*")


def _merged_squares(moments: Column) -> Column:
    """Squares about the common mean of several (n, mean, squares), merged one by one.

    Only differences of means are squared, so values far from zero lose nothing.
    """

    def merge(a: Column, x: Column) -> Column:
        total, apart = a["n"] + x["n"], x["mean"] - a["mean"]
        squares = a["sq"] + x["sq"] + apart * apart * a["n"] * x["n"] / total
        return F.struct(total.alias("n"), (a["mean"] + apart * x["n"] / total).alias("mean"), squares.alias("sq"))

    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("sq"))
    return F.aggregate(moments, zero, merge, lambda a: a["sq"])


def aggregation_facts(frame: DataFrame, location: str | None = None) -> DataFrame:
    """Long table of (type, metric, period) statistics as Decimal(10,2), from observation rows or day states.

    The days (a few thousand, whatever the input) are rolled up to their daily,
    monthly, seasonal and yearly periods. A period has at most 366 days; their
    means and squared deviations are merged in that order of days.
    """
    states = frame if aggregate.is_states(frame) else aggregate.day_states(frame)
    metrics = [(c, m) for c, m in METRICS.items() if aggregate.part(c, "N") in states.columns]
    types = ["DAILY", "MONTHLY", "SEASONAL", "YEARLY"]
    year, month = F.year("DATE"), F.month("DATE")
    keys = [F.unix_date("DATE"), year * 100 + month, year * 10 + season_index(month), year]
    periods = F.array(*[F.struct(F.lit(t).alias("t"), k.cast("long").alias("k")) for t, k in enumerate(keys)])
    fanned = _day_metrics(states, [c for c, _ in metrics]).select("*", F.explode(periods).alias("p")).select("*", "p.t", "p.k")
    count = F.col("n").cast("double")
    moment = F.struct("DATE", count.alias("n"), F.try_divide(F.col("s"), count).alias("mean"), F.col("sq").alias("sq"))
    sums = fanned.groupBy("t", "m", "k").agg(
        F.min("DATE").alias("period_start"),
        F.max("DATE").alias("period_end"),
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.array_sort(F.collect_list(F.when(F.col("n") > 0, moment))).alias("moments"),
    )
    n, total = F.col("n"), F.col("s")
    squares = _merged_squares(F.col("moments"))
    d = lambda x: x.try_cast("decimal(10,2)")
    name_of = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    k = F.col("k")
    label = (
        F.when(F.col("t") == 0, F.date_format(F.date_from_unix_date(k.cast("int")), "yyyy-MM-dd"))
        .when(F.col("t") == 1, F.format_string("%04d-%02d", F.floor(k / 100), k % 100))
        .when(F.col("t") == 2, F.concat_ws("-", F.floor(k / 10).cast("string"), name_of(SEASONS, k % 10)))
        .otherwise(k.cast("string"))
    )
    return sums.select(
        name_of(types, F.col("t")).alias("aggregation_type"),
        name_of([m for _, m in metrics], F.col("m")).alias("metric_name"),
        label.alias("period_key"),
        "period_start",
        "period_end",
        d(F.try_divide(total, n)).alias("value_mean"),
        d(F.col("lo")).alias("value_min"),
        d(F.col("hi")).alias("value_max"),
        d(F.when(n > 1, F.sqrt(squares / (n - 1)))).alias("value_std"),
        n.alias("value_count"),
        F.lit(location).cast("string").alias("location"),
    )


def linked_facts(facts: DataFrame, step_ids: dict[str, str]) -> DataFrame:
    """Facts with the ``transformation_id`` of the step that made their periods."""
    kind = F.col("aggregation_type")
    link = F.coalesce(*[F.when(kind == t, F.lit(step_ids[s])) for t, s in FACT_STEPS.items() if s in step_ids], F.lit(None).cast("string"))
    return facts.withColumn("transformation_id", link)


# ------------------------------------------------------------ quality checks


def _rule_flags(df: DataFrame, rules: ValidationRules) -> list[tuple[str, str, Column]]:
    return _rule_flags_of(df.columns, rules)


def _rule_flags_of(columns: list[str], rules: ValidationRules) -> list[tuple[str, str, Column]]:
    out: list[tuple[str, str, Column]] = [
        ("date_present", "completeness", F.col("DATE").isNull()),
        (
            "date_parseable",
            "validity",
            F.col("DATE").isNotNull() & F.try_to_date(F.col("DATE")).isNull(),
        ),
    ]
    ranges = [
        ("temperature_range", "TAVG", rules.temperature_min, rules.temperature_max),
        ("humidity_range", "RHUM", rules.humidity_min, rules.humidity_max),
        ("precipitation_range", "PRCP", rules.precipitation_min, None),
        ("wind_speed_range", "AWND", rules.wind_speed_min, None),
    ]
    for name, col, lo, hi in ranges:
        if col not in columns:
            continue
        c = F.col(col)
        ok = c >= lo if hi is None else (c >= lo) & (c <= hi)
        out.append((name, "range", c.isNotNull() & ~ok))
    return out


def quality_checks(
    raw: DataFrame, rules: ValidationRules = DEFAULT_RULES, tolerance: float = 0.05
) -> DataFrame:
    """Per rule: total, failed, passed (failed share <= tolerance), threshold %, actual %.

    One shuffle: rows are grouped on their full value with multiplicity, which
    both yields the duplicate count and shrinks the input of the rule counts.
    """
    grouped = raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("_n"))
    return _check_rows(grouped.agg(*check_counts(raw, rules)), rules, raw.columns, tolerance)


def check_counts(raw: DataFrame, rules: ValidationRules = DEFAULT_RULES, times: str = "_n") -> list[Column]:
    """Counts of all checks over de-duplicated rows with their multiplicity; they can be observed on the cleaning pass."""
    n = F.col(times)
    failed = [F.sum(F.when(c, n).otherwise(0)).alias(name) for name, _, c in _rule_flags(raw, rules)]
    return [F.sum(n).alias("_total"), F.sum(n - 1).alias("duplicate_rows"), *failed]


def observed_checks(
    spark: SparkSession, counts: dict, columns: list[str], rules: ValidationRules = DEFAULT_RULES, tolerance: float = 0.05
) -> DataFrame:
    """The rows of ``quality_checks`` from observed counts (none: an empty input)."""
    names = ["_total", "duplicate_rows", *[n for n, _, _ in _rule_flags_of(columns, rules)]]
    one = spark.createDataFrame([tuple(counts.get(n) for n in names)], ", ".join(f"{n} long" for n in names))
    return _check_rows(one, rules, columns, tolerance)


def _check_rows(one: DataFrame, rules: ValidationRules, columns: list[str], tolerance: float) -> DataFrame:
    """One row of counts as one row for each check."""
    checks = [("duplicate_rows", "uniqueness")] + [(n, t) for n, t, _ in _rule_flags_of(columns, rules)]
    rows = one.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("check_name"),
                        F.lit(t).alias("check_type"),
                        F.coalesce(F.col(n), F.lit(0)).cast("long").alias("failed_records"),
                    )
                    for n, t in checks
                ]
            )
        ).alias("_c"),
        F.coalesce(F.col("_total"), F.lit(0)).cast("long").alias("total_records"),
    )
    share = F.try_divide(F.col("_c.failed_records").cast("double"), F.col("total_records"))
    return rows.select(
        F.col("_c.check_name").alias("check_name"),
        F.col("_c.check_type").alias("check_type"),
        F.coalesce(share <= tolerance, F.lit(True)).alias("passed"),
        "total_records",
        F.col("_c.failed_records").alias("failed_records"),
        F.lit(tolerance * 100.0).cast("decimal(10,2)").alias("threshold_value"),
        F.coalesce(share * 100.0, F.lit(0.0)).try_cast("decimal(10,2)").alias("actual_value"),
    )


def quality_score(raw: DataFrame, rules: ValidationRules = DEFAULT_RULES) -> DataFrame:
    """records_count, records_valid (rows kept by cleaning), records_invalid, score 0-100."""
    from nimbus.operators.clean import clean_report

    rep = clean_report(raw, rules)
    return rep.select(
        F.col("initial").alias("records_count"),
        F.col("final").alias("records_valid"),
        F.col("removed").alias("records_invalid"),
        F.when(F.col("initial") > 0, F.col("final") / F.col("initial") * 100.0)
        .otherwise(F.lit(0.0))
        .try_cast("decimal(5,2)")
        .alias("data_quality_score"),
    )
