"""Consecutive spans of a sorted order, each small enough for one task.

Rows are range-partitioned on the order (Spark samples the bounds), each row is
marked with the number of its span, and the result is stored: the numbers are
then facts of a table, whatever is recomputed later. A value that repeats often
stays in one span, so callers fold ties before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbus.session import cut_lineage

SPAN = "_span"


def spanned(stored: DataFrame, order: list[Column], span_rows: int) -> tuple[DataFrame, list[int]]:
    """(rows with their span, rows in each span). The number of spans follows the number of rows.

    ``stored`` is read twice (to sample and to deal), so it should come from storage.
    """
    n = max(2, -(-stored.count() // span_rows))
    dealt = cut_lineage(stored.repartitionByRange(n, *order).withColumn(SPAN, F.spark_partition_id()), "spans")
    found = dict(dealt.groupBy(SPAN).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each span
    return dealt, [found.get(i, 0) for i in range(n)]
