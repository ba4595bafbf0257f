"""Approximate nearest neighbours by shifted space-filling curves.

Every vector is projected several times to a few dimensions, shifted and
ordered along a Hilbert curve. Spark range-partitions and sorts each ordering;
a query is compared with all rows whose position on a curve is within a window
of its own, and the windows of all curves are merged and ranked by the exact
distance. The curves are laid out from means and deviations over all rows and
every row is on every curve.

Nearest neighbours in high-dimensional data without structure spread far over
any curve, so the window is a share of the rows (`share`) plus a constant
(`base`); for clustered embeddings a smaller share reaches the same recall.

Defined results for odd input: rows without an id, with a null, empty or zero
vector or with null or non-finite components take no part; equal vectors are
ranked by id and only the first k + 1 of them are candidates, which is all that
any query can need; a query with fewer candidates than k gets all; equal
distances go to the smaller id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nimbus.llm.vectors import finite, matrix, nonzero
from nimbus.session import unique_scratch

RESULT = "query_id long, rank int, vec_id long, score double"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (n, m) with `bits` bits a coordinate; m * bits < 64.

    The Gray-code transform of the coordinates, then their bits interleaved.
    """
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    m, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        top, low = np.uint64(b), np.uint64((1 << b) - 1)
        for i in range(m):
            set_ = (x[i] >> top) & one == one
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, m):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[m - 1] >> np.uint64(b)) & one == one, np.uint64((1 << b) - 1), np.uint64(0))
    key = np.zeros_like(flip)
    for b in range(bits - 1, -1, -1):
        for i in range(m):
            key = (key << one) | (((x[i] ^ flip) >> np.uint64(b)) & one)
    return key


def distances(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances; added up in the order of the components, so that equal pairs give equal sums."""
    total = np.zeros(len(rows))
    for j in range(len(q)):
        total += (rows[:, j] - q[j]) ** 2
    return np.sqrt(total)


def projections(width: int, curves: int, dims: int, seed: int) -> np.ndarray:
    """(curves, width, dims): an orthonormal projection for every curve."""
    rng = np.random.default_rng(seed)
    dims = min(dims, width)
    return np.stack([np.linalg.qr(rng.normal(size=(width, dims)))[0] for _ in range(curves)])


def search(
    table: DataFrame,
    queries: DataFrame,
    k: int,
    curves: int = 32,
    dims: int = 8,
    bits: int = 7,
    share: float = 0.01,
    base: int = 64,
    block: int = 1024,
    seed: int = 5,
) -> DataFrame:
    """`query_id, rank, vec_id, score` from `vec_id, embedding` on both sides."""
    spark = table.sparkSession

    def clean(t: DataFrame) -> DataFrame:
        t = t.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        return t.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")) & nonzero(F.col("embedding")))

    kind = dict(table.dtypes)["embedding"]
    first = clean(table).limit(1).collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    width = len(first[0]["embedding"])
    maps = projections(width, curves, dims, seed)
    shifts = np.random.default_rng(seed + 1).uniform(-0.15, 0.15, size=(curves, maps.shape[2]))

    equal = Window.partitionBy("embedding").orderBy("vec_id")
    rows = clean(table).withColumn("_n", F.row_number().over(equal)).where(F.col("_n") <= k + 1).drop("_n")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                y = np.einsum("nw,cwm->ncm", matrix(b.column(0)), maps).reshape(b.num_rows, -1)
                n, s, ss = n + len(y), s + y.sum(axis=0), ss + (y**2).sum(axis=0)
        if n:
            size = len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(np.full(size, n)), pa.array(s), pa.array(ss)], ["i", "n", "s", "ss"])

    totals = rows.select("embedding").mapInArrow(moments, "i long, n long, s double, ss double")
    found = totals.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).orderBy("i").collect()
    n_rows = found[0]["n"]  # one row for each coordinate of each curve
    mean = np.array([r["s"] / r["n"] for r in found]).reshape(curves, -1)
    spread = np.sqrt(np.maximum([r["ss"] / r["n"] for r in found] - mean.reshape(-1) ** 2, 1e-24)).reshape(curves, -1)
    window = int(np.ceil(share * n_rows)) + base

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column(2))
            for c in range(curves):
                unit = (v @ maps[c] - mean[c]) / (6 * spread[c]) + 0.5 + shifts[c]
                cells = np.clip(unit * (1 << bits), 0, (1 << bits) - 1).astype(np.uint64)
                key = hilbert_keys(cells, bits).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, c, np.int32)), pa.array(key), *b.columns], ["curve", "key", "vec_id", "asks", "v"])

    every = rows.withColumn("asks", F.lit(False)).unionByName(clean(queries).withColumn("asks", F.lit(True)))
    keys = every.select("vec_id", "asks", F.col("embedding").alias("v")).mapInArrow(keyed, f"curve int, key long, vec_id long, asks boolean, v {kind}")
    parts = max(curves, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = keys.repartitionByRange(parts, "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id", "asks")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers the candidate rows of each curve in a sorted partition; a query gets the number of the row before it."""
        at, curve, held = TaskContext.get().partitionId(), -1, 0
        for b in batches:
            curves_, asks = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            local = np.zeros(b.num_rows, np.int64)
            for c in np.unique(curves_):
                mine = curves_ == c
                held = held if c == curve else 0
                curve = c
                counted = np.cumsum(~asks[mine]) + held
                local[mine], held = counted, int(counted[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(np.full(b.num_rows, at, np.int32)), pa.array(local)], ["curve", "vec_id", "asks", "v", "part", "local"])

    path = unique_scratch(spark, "curves")
    schema = f"curve int, vec_id long, asks boolean, v {kind}, part int, local long"
    ordered.select("curve", "vec_id", "asks", "v").mapInArrow(numbered, schema).write.parquet(path)
    lines = spark.read.schema(schema).parquet(path)
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("curve", "part").agg(F.max("local").alias("n"))  # a row for each curve and partition
    starts = starts.select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = lines.join(starts, ["curve", "part"]).select("curve", "vec_id", "asks", "v", (F.col("start") + F.col("local")).alias("at"))
    cands = placed.where(~F.col("asks")).select("curve", F.floor(F.col("at") / block).alias("block"), "at", "vec_id", "v")
    lo, hi = F.greatest(F.floor((F.col("at") - window) / block), F.lit(0)), F.least(F.floor((F.col("at") + window) / block), F.lit(n_rows // block))
    asks = placed.where("asks").select("curve", F.explode(F.sequence(lo, F.greatest(lo, hi))).alias("block"), "at", "vec_id", "v").toDF("q_curve", "q_block", "q_at", "query_id", "q_v")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            qs, rs = matrix(left["q_v"]), matrix(right["v"])
            ids, at = right["vec_id"].to_numpy(), right["at"].to_numpy()
            for q, qid, qat in zip(qs, left["query_id"].to_numpy(), left["q_at"].to_numpy(), strict=True):
                near = (np.abs(at - qat) <= window) & (ids != qid)
                d = distances(rs[near], q)
                top = np.lexsort((ids[near], d))[:k]
                for column, value in zip(out, (np.full(len(top), qid), ids[near][top], d[top]), strict=True):
                    column.append(value)
        return pa.table({"query_id": np.concatenate(out[0]), "vec_id": np.concatenate(out[1]), "score": np.concatenate(out[2])})

    pairs = asks.groupBy("q_curve", "q_block").cogroup(cands.groupBy("curve", "block")).applyInArrow(compare, "query_id long, vec_id long, score double")
    merged = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return merged.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_curve_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every vector whose id is divisible by 100, against all rows."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(table, table.where(F.col("vec_id") % 100 == 0), 10)
