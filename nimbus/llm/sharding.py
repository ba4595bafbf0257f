"""Sharding by sampled splitters.

Rows are ordered by a key. A size-weighted sample of the keys (its size is a
parameter's, not the table's) gives quantile boundaries that cut the order into
many small ranges; the exact load of every range is counted, and ranges that
came out overfull are sampled again and cut further, also inside one hot key.
Each range is then sorted in its own task, and the loads of the ranges before
it place every row at its exact offset in the whole order, so the shards are
consecutive stretches of almost equal size whatever the sample was.

Laws: `bytes` (a row goes where the middle of its bytes falls; two shards
differ by at most the two rows at their ends) and `rows` (counts differ by at
most one).

Defined results for odd input: a null key or tie counts as the smallest; sizes
below one count as one; rows that are equal in everything take consecutive
slots; a shard that no row falls into is empty; an empty table gives an empty
result. The input's columns come back in the struct `row`, so none can clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nimbus.session import cut_lineage

LAWS = ("bytes", "rows")
ORDER = ("key", "tie", "at")
LEAST = -(1 << 63)


def order_bytes(key: np.ndarray, tie: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Strings of 24 bytes that sort like (key, tie, at)."""
    top = np.uint64(1 << 63)
    parts = np.stack([x.astype(np.int64).view(np.uint64) ^ top for x in (key, tie, at)], axis=1)
    return np.ascontiguousarray(parts.astype(">u8")).view("S24").ravel()


def quantiles(sample: list, ranges: int) -> np.ndarray:
    """At most `ranges - 1` boundaries that cut a weighted sample (key, tie, at, draws) into equal parts."""
    if not sample:
        return np.zeros(0, "S24")
    at = order_bytes(*[np.array([r[c] for r in sample], np.int64) for c in ORDER])
    draws = np.array([r["draws"] for r in sample], np.int64)
    sort = np.argsort(at)
    reach = np.cumsum(draws[sort])
    cuts = np.searchsorted(reach, np.arange(1, ranges) * reach[-1] / ranges)
    return np.unique(at[sort][np.minimum(cuts, len(sort) - 1)])


def ranged(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Adds `range`: the number of splitters that are not above the row."""
    cuts = splitters.tobytes()

    @F.pandas_udf("int")
    def of(key: pd.Series, tie: pd.Series, at: pd.Series) -> pd.Series:
        mine = order_bytes(key.to_numpy(), tie.to_numpy(), at.to_numpy())
        return pd.Series(np.searchsorted(np.frombuffer(cuts, "S24"), mine, "right").astype(np.int32))

    return rows.withColumn("range", of(*ORDER))


def sampled(rows: DataFrame, aim: float, oversample: int, seed: int) -> list:
    """Keys drawn `oversample` times for each `aim` of weight; the expected number of draws is fixed by the two."""
    chance = F.pmod(F.xxhash64(*ORDER, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    draws = F.floor(F.col("weight") * (oversample / aim) + chance)
    return rows.select(*ORDER, draws.alias("draws")).where("draws > 0").collect()


def splitters_of(rows: DataFrame, total: int, ranges: int, oversample: int, seed: int) -> tuple[np.ndarray, list]:
    """Boundaries with no overfull range between them, and the exact load of every range."""
    aim = total / ranges
    splitters = quantiles(sampled(rows, aim, oversample, seed), ranges)
    while True:
        load = [F.sum("weight").alias("weight"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("weight").alias("most")]
        found = ranged(rows, splitters).groupBy("range").agg(*load).orderBy("range").collect()  # a row for each range
        # beyond one row's own weight, more than twice the aim can always be cut again
        over = {r["range"]: r["weight"] for r in found if r["weight"] > 2 * aim + r["most"]}
        if not over:
            return splitters, found
        seed += 1
        inside = ranged(rows, splitters).where(F.col("range").isin(list(over)))
        drawn: dict[int, list] = {r: [] for r in over}
        sample = sampled(inside, aim, oversample, seed)
        at = order_bytes(*[np.array([x[c] for x in sample], np.int64) for c in ORDER]) if sample else np.zeros(0, "S24")
        for x, r in zip(sample, np.searchsorted(splitters, at, "right").tolist(), strict=True):
            drawn[r].append(x)
        more = [quantiles(drawn[r], int(-(-w // aim))) for r, w in over.items()]
        splitters = np.unique(np.concatenate([splitters, *more]))


def assign(
    table: DataFrame,
    key: Column,
    size: Column,
    shards: int = 16,
    law: str = "bytes",
    tie: Column | None = None,
    ranges_per_shard: int = 64,
    range_rows: int = 4_000_000,
    oversample: int = 16,
    seed: int = 11,
) -> DataFrame:
    """`row, size, shard, slot` for every row of the table.

    `key` and `tie` are long columns: rows are ordered by both (then as read), and
    a shard is a stretch of that order. There are `ranges_per_shard` ranges a shard
    or one for each `range_rows` rows, and `oversample` draws for each range.
    """
    if law not in LAWS:
        raise ValueError(f"unknown law {law!r}; one of {', '.join(LAWS)}")
    spark, least = table.sparkSession, F.lit(LEAST)
    bulk = F.greatest(F.coalesce(size.cast("long"), F.lit(1)), F.lit(1))
    rows = table.select(
        F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("row"),
        F.coalesce(key.cast("long"), least).alias("key"),
        F.coalesce(tie.cast("long"), least).alias("tie") if tie is not None else F.lit(0).cast("long").alias("tie"),
        F.monotonically_increasing_id().alias("at"),
        bulk.alias("size"),
    ).withColumn("weight", F.col("size") if law == "bytes" else F.lit(1).cast("long"))
    # written once: the sample, the counts and the final pass see the same numbers
    rows = cut_lineage(rows, "sharding")
    total, n = rows.agg(F.sum("weight"), F.count(F.lit(1))).first()
    if not n:
        return rows.select("row", "size", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = max(shards * ranges_per_shard, -(-n // range_rows))
    splitters, loads = splitters_of(rows, total, ranges, oversample, seed)

    weights, counts = np.array([r["weight"] for r in loads]), np.array([r["n"] for r in loads])
    first_weight, first_row = np.cumsum(weights) - weights, np.cumsum(counts) - counts
    offsets = [(int(r["range"]), int(w), int(c)) for r, w, c in zip(loads, first_weight, first_row, strict=True)]
    starts = F.broadcast(spark.createDataFrame(offsets, "range int, first_weight long, first_row long"))  # a row for each range

    def placed(part: DataFrame) -> DataFrame:
        order = Window.partitionBy("range").orderBy(*ORDER)
        here = part.withColumn("_n", F.row_number().over(order)).withColumn("_w", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        # twice the middle of the row in the whole order, so that all numbers stay whole
        middle = 2 * (F.col("first_weight") + F.col("_w")) - F.col("weight")
        here = here.join(starts, "range").withColumn("_middle", middle)
        shard = F.expr(f"_middle * {shards}L div {2 * total}L").cast("int")
        return here.select("row", "size", shard.alias("shard"), (F.col("first_row") + F.col("_n") - 1).alias("number"))

    every = ranged(rows, splitters)
    # a shard begins in the range that holds its point of the order, or with the next range
    points = np.searchsorted(first_weight, np.arange(shards) * total / shards, "right") - 1
    edges = sorted({int(loads[min(p + d, len(loads) - 1)]["range"]) for p in points for d in (-1, 0, 1) if p + d >= 0})
    begins = {r["shard"]: r["n"] for r in placed(every.where(F.col("range").isin(edges))).groupBy("shard").agg(F.min("number").alias("n")).collect()}
    first = F.array(*[F.lit(begins.get(s)).cast("long") for s in range(shards)])
    return placed(every).select("row", "size", "shard", (F.col("number") - F.element_at(first, F.col("shard") + 1)).alias("slot"))


def write_shards(assigned: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Writes `shard=N` folders of Parquet files, each in the order of the slots."""
    shards = assigned.agg(F.countDistinct("shard")).first()[0]
    parts = max(1, shards * files_per_shard)
    flat = assigned.select("row", "slot", "shard")
    flat.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def text_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in 16 shards of near equal bytes; copies of one text lie side by side in the order."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    narrow = documents.select("doc_id", F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), (text_bytes(F.col("text")) + 1).alias("size"))
    found = assign(narrow, F.col("key"), F.col("size"), shards=16, law="bytes", tie=F.col("doc_id"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "size", F.col("row.text_crc32").alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
