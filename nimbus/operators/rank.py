"""Exact ``rank()`` over a whole table without a single-task window.

``rank() over (order by v desc nulls last)`` needs, for every value, the
number of rows with a greater value. Computed in parallel:

1. ties are collapsed: one row per distinct value with its row count (a hash
   aggregate, so a value shared by a third of the rows is one row here);
2. the distinct values are dealt into consecutive spans of a bounded number of
   values (``spans``), so their number grows with the distinct values;
3. rows above a value = rows in all spans before (a running sum over the
   spans' totals) + rows with a greater value in the same span (a window
   partitioned by span);
4. the rank is joined back to the rows on the value.

The bounds only balance the spans; correctness does not depend on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nimbus.operators.spans import SPAN, spanned
from nimbus.session import cut_lineage


def rank_desc(df: DataFrame, col: str, out: str, buckets: int | None = None, span_values: int = 100_000) -> DataFrame:
    """Add ``out`` = rank of ``col`` in descending order, nulls last (ties share a rank).

    There is a span for each ``span_values`` distinct values, or ``buckets`` of them.
    """
    spark, v = df.sparkSession, F.col(col)
    vals = cut_lineage(df.filter(v.isNotNull()).groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "rank-values")
    if buckets:
        span_values = max(1, -(-vals.count() // buckets))
    dealt, _ = spanned(vals, [F.col("_v").desc()], span_values)
    totals = dict(dealt.groupBy(SPAN).agg(F.sum("_n").alias("n")).collect())  # a row for each span
    above, running = [], 0
    for span in sorted(totals):
        above.append((span, running))
        running += totals[span]
    starts = spark.createDataFrame(above, f"{SPAN} int, _above long")
    within = Window.partitionBy(SPAN).orderBy(F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        dealt.withColumn("_within", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .join(F.broadcast(starts), SPAN)
        .select(F.col("_v"), (F.col("_above") + F.col("_within") + 1).cast("int").alias(out))
    )
    joined = df.join(ranks, v.eqNullSafe(F.col("_v")), "left").drop("_v")
    return joined.withColumn(out, F.when(v.isNull(), F.lit(running + 1).cast("int")).otherwise(F.col(out)))
