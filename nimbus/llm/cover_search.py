"""Exact top-k inner product search with cover trees on both sides.

Queries and rows are dealt to the nearest of a bounded number of pivots and cut
into blocks of bounded size. Every block gets a cover tree (a centre and a
covering radius for each node). A query block meets every row block once, in
its own task; inside, both trees are walked together and a pair of nodes is
dropped when its best possible product is below the worst kth score of the
query group. Query blocks meet the row blocks of their own pivot first; the
kth scores found there prune the rest.

Defined results for odd input: rows without an id, with a null vector or with
null or non-finite components take no part; a query with fewer candidates than
k gets all of them; rows that repeat the query's id are not its candidates;
equal scores go to the smaller id; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nimbus.llm.vectors import matrix, usable
from nimbus.session import unique_scratch

NO_SCORE = np.iinfo(np.int64).min + 1  # can be negated


class CoverTree:
    """Nodes over a permuted block of points: slice, centre, covering radius and children of each."""

    def __init__(self, points: np.ndarray, leaf: int = 128, shrink: float = 1.5):
        self.points = points.astype(np.float64)
        self.order = np.arange(len(points))
        self.first, self.last, self.centre, self.radius, self.children = [], [], [], [], []
        self._build(0, len(points), leaf, shrink)

    def _build(self, a: int, b: int, leaf: int, shrink: float) -> int:
        """A node over order[a:b]; its children cover it at a radius smaller by `shrink`."""
        node = len(self.first)
        rows = self.order[a:b]
        pts = self.points[rows]
        centre = pts.mean(axis=0) if len(pts) else pts.sum(axis=0)
        far = np.sqrt(((pts - centre) ** 2).sum(axis=1)) if len(pts) else np.zeros(0)
        radius = float(far.max(initial=0.0))
        for column, value in ((self.first, a), (self.last, b), (self.centre, centre), (self.radius, radius), (self.children, [])):
            column.append(value)
        if b - a <= leaf or radius == 0.0:
            return node
        # greedy cover: a child takes the free points within the smaller radius of
        # its seed; at most 16 seeds far from one another, the rest to the nearest
        seeds, near = [int(np.argmax(far))], None
        while len(seeds) < 16:
            d = np.sqrt(((pts - pts[seeds[-1]]) ** 2).sum(axis=1))
            near = d if near is None else np.minimum(near, d)
            if near.max() <= radius / shrink:
                break
            seeds.append(int(np.argmax(near)))
        to = np.argmin(((pts[:, None, :] - pts[seeds][None, :, :]) ** 2).sum(axis=2), axis=1)
        sort = np.argsort(to, kind="stable")
        self.order[a:b] = rows[sort]
        cuts = np.cumsum(np.bincount(to, minlength=len(seeds)))
        if cuts[0] == b - a:  # nothing was split
            return node
        lo = a
        for cut in cuts:
            if a + cut > lo:
                self.children[node].append(self._build(lo, a + int(cut), leaf, shrink))
            lo = a + int(cut)
        return node


class Best:
    """The k best (score, id) of every query of a block, smaller ids first among equals."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.scores = np.full((n, k), NO_SCORE)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, rows: np.ndarray) -> int:
        return int(np.maximum(self.scores[rows, -1], self.floor[rows]).min(initial=np.iinfo(np.int64).max))

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        least = np.maximum(self.scores[rows, -1], self.floor[rows])
        for i in np.flatnonzero((scores >= least[:, None]).any(axis=1)):
            r = rows[i]
            take = scores[i] >= least[i]
            s, d = np.r_[self.scores[r], scores[i][take]], np.r_[self.ids[r], ids[take]]
            top = np.lexsort((d, -s))[: self.k]
            self.scores[r], self.ids[r] = s[top], d[top]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; in float64 where every partial sum stays below 2**53."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if bound < 2**53 else a @ b.T


def dual_search(queries, query_ids, rows, row_ids, k: int, floor: np.ndarray) -> Best:
    """Both cover trees walked together, nearest pairs first."""
    best = Best(len(queries), k, floor)
    if not len(queries) or not len(rows):
        return best
    qt, rt = CoverTree(queries), CoverTree(rows)
    norm_q, norm_r = [float(np.linalg.norm(c)) for c in qt.centre], [float(np.linalg.norm(c)) for c in rt.centre]

    def bound(q: int, r: int) -> float:
        top = float(qt.centre[q] @ rt.centre[r]) + norm_q[q] * rt.radius[r] + norm_r[r] * qt.radius[q] + qt.radius[q] * rt.radius[r]
        return top + 1e-6 * (1 + abs(top))  # rounding of the bound itself

    stack = [(bound(0, 0), 0, 0)]
    while stack:
        top, q, r = stack.pop()
        mine = qt.order[qt.first[q] : qt.last[q]]
        if top < best.worst(mine):
            continue
        if not qt.children[q] and not rt.children[r]:
            there = rt.order[rt.first[r] : rt.last[r]]
            scores = products(queries[mine], rows[there])
            scores[query_ids[mine][:, None] == row_ids[there][None, :]] = NO_SCORE
            best.offer(mine, scores, row_ids[there])
            continue
        split_q = qt.children[q] and (not rt.children[r] or qt.radius[q] >= rt.radius[r])
        pairs = [(c, r) for c in qt.children[q]] if split_q else [(q, c) for c in rt.children[r]]
        stack.extend(sorted((bound(*p), *p) for p in pairs))  # the best pair is taken first
    return best


def _dealt(rows: DataFrame, pivots: np.ndarray, block: int) -> tuple[DataFrame, dict[int, list[int]]]:
    """`vec_id, v, block` and the blocks of each pivot; blocks hold about `block` rows."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = matrix(b.column(1))
                near = ((v**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * v @ pivots.T).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32))], ["vec_id", "v", "pivot"])

    at = rows.select("vec_id", "v").mapInArrow(nearest, "vec_id long, v array<long>, pivot int")
    counts = {r["pivot"]: r["n"] for r in at.groupBy("pivot").agg(F.count("*").alias("n")).collect()}  # a row for each pivot
    blocks, first = {}, 0
    for p in sorted(counts):
        n = -(-counts[p] // block)
        blocks[p] = list(range(first, first + n))
        first += n
    if not blocks:
        return at.select("vec_id", "v", F.lit(0).alias("block")), blocks
    start = F.element_at(F.create_map(*[F.lit(x) for p in blocks for x in (p, blocks[p][0])]), F.col("pivot"))
    many = F.element_at(F.create_map(*[F.lit(x) for p in blocks for x in (p, len(blocks[p]))]), F.col("pivot"))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), many).cast("int")
    return at.select("vec_id", "v", (start + salt).alias("block")), blocks


def _packed(rows: DataFrame, prefix: str) -> DataFrame:
    """One row for each block: its ids and its matrix, as bytes."""

    def pack(table: pa.Table) -> pa.Table:
        v = matrix(table["v"], np.int64)
        return pa.table({"block": table["block"][:1].cast(pa.int32()), "ids": [table["vec_id"].to_numpy().tobytes()], "data": pa.array([v.tobytes()], pa.binary())})

    packed = rows.groupBy("block").applyInArrow(pack, "block int, ids binary, data binary")
    return packed.toDF(f"{prefix}block", f"{prefix}ids", f"{prefix}data")


def top_k(queries: DataFrame, rows: DataFrame, k: int, pivots: int = 16, query_block: int = 512, row_block: int = 2048) -> DataFrame:
    """`query_id, rank, vec_id, score` for integer vectors `vec_id, v array<long>` on both sides.

    `pivots` bounds the sample that the blocks are laid out by; it changes no result.
    """
    spark = rows.sparkSession
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    schema = "query_id long, vec_id long, score long"
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centres = np.array([r["v"] for r in found], np.float64)
    q, q_blocks = _dealt(queries, centres, query_block)
    r, r_blocks = _dealt(rows, centres, row_block)
    if not q_blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q, r = _packed(q, "q_"), _packed(r, "r_")

    def meet(home: bool, floors: DataFrame | None) -> DataFrame:
        """Every pair of a query block and a row block (of one pivot, or of two), one row each."""

        def partners(of: dict[int, list[int]], other: dict[int, list[int]], column: str) -> Column:
            to = [(p, x) for p, b in of.items() for x in b]
            pivot = F.element_at(F.create_map(*[F.lit(v) for p, x in to for v in (x, p)]), F.col(column))
            every = F.sequence(F.lit(0), F.lit(sum(map(len, other.values())) - 1))
            spans = F.create_map(*[v for p in set(of) for v in (F.lit(p), F.array(F.lit(min(other.get(p, [0]))), F.lit(max(other.get(p, [-1])))))])
            span = F.element_at(spans, pivot)
            inside = lambda x: (x >= span[0]) & (x <= span[1])
            return F.explode(F.filter(every, inside if home else lambda x: ~inside(x)))

        qs = q.withColumn("r_block", partners(q_blocks, r_blocks, "q_block"))
        rs = r.withColumn("q_block", partners(r_blocks, q_blocks, "r_block"))
        if floors is not None:
            qs = qs.join(floors, "q_block", "left")
        else:
            qs = qs.withColumn("floors", F.lit(None).cast("array<struct<query_id:long,score:long>>"))
        pairs = qs.join(rs, ["q_block", "r_block"]).select("q_block", "q_ids", "q_data", "floors", "r_ids", "r_data")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    qi, ri = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["r_ids"], np.int64)
                    qv = np.frombuffer(row["q_data"], np.int64).reshape(len(qi), -1)
                    rv = np.frombuffer(row["r_data"], np.int64).reshape(len(ri), -1)
                    known = {x["query_id"]: x["score"] for x in row["floors"] or []}
                    floor = np.array([known.get(i, NO_SCORE) for i in qi.tolist()], np.int64)
                    best = dual_search(qv, qi, rv, ri, k, floor)
                    at, _ = np.nonzero(best.scores > NO_SCORE)
                    ok = best.scores > NO_SCORE
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), row["q_block"], np.int32)), pa.array(qi[at]), pa.array(best.ids[ok]), pa.array(best.scores[ok])],
                        ["q_block", "query_id", "vec_id", "score"],
                    )

        return pairs.mapInArrow(search, "q_block int, " + schema)

    order = [F.desc("score"), F.asc("vec_id")]
    ranked = Window.partitionBy("query_id").orderBy(*order)
    # the home pass is read twice (its kth scores prune the rest), so it is written once
    path = unique_scratch(spark, "top-k-home")
    meet(True, None).write.parquet(path)
    home = spark.read.schema("q_block int, " + schema).parquet(path)
    kth = home.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k)
    floors = kth.groupBy("q_block").agg(F.collect_list(F.struct("query_id", "score")).alias("floors"))  # a block of queries
    both = home.unionByName(meet(False, floors)).drop("q_block")
    return (
        both.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def quantized(table: DataFrame, scale: float = 256.0) -> DataFrame:
    """`vec_id, v`: floor(scale * x) of every component."""
    return usable(table).select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x)).alias("v"))


def op3_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 inner products of every vector whose id is divisible by 50, against all rows."""
    rows = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows.where(F.col("vec_id") % 50 == 0), rows, 5)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id
), k AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM k WHERE n <= 5
"""
