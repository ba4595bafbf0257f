"""Hard-negative mining with an inverted multi-index.

Every vector is cut into two halves; each half has a codebook, and a pair of
codes is a cell that lists its rows, with the largest distance of its rows to
the two codewords. For an anchor, the product of each half with a codeword plus
its length times the radius bounds the half-score of all rows under that code. A
heap visits the cells by the descending sum of both bounds (the multi-sequence
walk) and stops as soon as no cell ahead can change the answer.

The walk runs over the cells' sizes and radii alone, where the anchors are; the
vectors of an anchor go only to the cells that it visits. It has two rounds for
each question. The first visits the best cells until they hold `probe_rows` rows,
and its results are a floor; the second takes the cells whose bound still
reaches the floor. First the positives (the best of the anchor's own label) are
certified in this way, then, for the window of scores that each positive opens,
the best rows of other labels; a window is certified once no cell ahead reaches
its last score or its lower end. The result is exact; codebooks fitted on a
sample (`sample` rows) change only how much is visited.

Defined results for odd input: rows with a null id, label or vector, an empty
vector, or null or non-finite components take no part; rows that repeat the
anchor's id are none of its candidates; repeated anchors and candidates count as
rows of their own; equal scores go to the smaller id; an anchor without rows of
its label, or with empty windows, has no result; vectors of different lengths
raise; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nimbus.llm.cover_search import products
from nimbus.llm.vectors import finite, matrix
from nimbus.session import cut_lineage

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
NOTHING = -(1 << 62)


class MultiIndex:
    """Codebooks of both halves with the cells' sizes, blocks and radii."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray]):
        self.books = books
        self.half = books[0].shape[1]
        self.codes = (len(books[0]), len(books[1]))
        self.size = np.zeros(self.codes, np.int64)
        self.blocks = np.zeros(self.codes, np.int64)
        self.radius = np.zeros((2, *self.codes))

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of every vector, and its distances to the codewords of both halves."""
        codes, far = [], []
        for book, part in zip(self.books, (v[:, : self.half], v[:, self.half :]), strict=True):
            near = ((part**2).sum(1)[:, None] + (book**2).sum(1)[None] - 2 * part @ book.T).argmin(axis=1)
            codes.append(near)
            far.append(np.sqrt(((part - book[near]) ** 2).sum(axis=1)))
        return codes[0] * self.codes[1] + codes[1], np.stack(far)

    def count(self, cell: int, size: int, blocks: int, far: tuple[float, float]) -> None:
        at = divmod(cell, self.codes[1])
        self.size[at], self.blocks[at] = size, blocks
        self.radius[(0, *at)], self.radius[(1, *at)] = far

    def walk(self, v: np.ndarray) -> Iterator[tuple[float, int, float, float]]:
        """(bound of all that is ahead, cell, least, most) by descending bound; a cell's own scores lie between the last two."""
        halves = (v[: self.half].astype(np.float64), v[self.half :].astype(np.float64))
        score = [book @ q for book, q in zip(self.books, halves, strict=True)]
        length = [float(np.linalg.norm(q)) for q in halves]
        top = [s + n * self.radius[h].max(axis=1 - h) for h, (s, n) in enumerate(zip(score, length, strict=True))]
        order = [np.argsort(-t, kind="stable") for t in top]
        heap, seen = [(-(top[0][order[0][0]] + top[1][order[1][0]]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            at = (int(order[0][i]), int(order[1][j]))
            if self.size[at]:
                centre = score[0][at[0]] + score[1][at[1]]
                reach = length[0] * self.radius[(0, *at)] + length[1] * self.radius[(1, *at)]
                slack = 1e-6 * (1 + abs(centre) + reach)  # rounding of the bounds themselves
                yield -bound + slack, at[0] * self.codes[1] + at[1], centre - reach - slack, centre + reach + slack
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < self.codes[0] and y < self.codes[1] and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-(top[0][order[0][x]] + top[1][order[1][y]]), x, y))


def codebook(points: np.ndarray, codes: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of k-means over a sample."""
    rng = np.random.default_rng(seed)
    book = points[rng.choice(len(points), min(codes, len(points)), replace=False)]
    for _ in range(rounds):
        near = ((book**2).sum(1)[None] - 2 * points @ book.T).argmin(axis=1)
        for c in range(len(book)):
            if (near == c).any():
                book[c] = points[near == c].mean(axis=0)
    return book


def build(rows: DataFrame, codes: int, block_rows: int, sample: int, seed: int = 13) -> tuple[MultiIndex, DataFrame]:
    """The index of `vec_id, label, v`, and its lists: `cell, block, ids, labels, data`, one row for each block of a cell."""
    drawn = rows.select("v").orderBy(F.xxhash64("vec_id", "v")).limit(sample).toArrow()
    points = matrix(drawn["v"])
    half = max(1, points.shape[1] // 2)
    index = MultiIndex((codebook(points[:, :half], codes, 8, seed), codebook(points[:, half:], codes, 8, seed + 1)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, far = index.place(matrix(b.column(2)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far[0]), pa.array(far[1])], ["vec_id", "label", "v", "cell", "far_0", "far_1"])

    placed = rows.mapInArrow(place, "vec_id long, label long, v array<long>, cell int, far_0 double, far_1 double")
    placed = cut_lineage(placed.withColumn("at", F.monotonically_increasing_id()), "multi-index")
    # a row for each cell: at most `codes` squared
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far_0").alias("a"), F.max("far_1").alias("b")).collect():
        index.count(r["cell"], r["n"], -(-r["n"] // block_rows), (r["a"], r["b"]))
    many = F.element_at(F.lit(index.blocks.ravel().tolist()), F.col("cell") + 1)

    def pack(group: pa.Table) -> pa.Table:
        v = matrix(group["v"], np.int64)
        out = [group["cell"][:1], group["block"][:1], [group["vec_id"].to_numpy().tobytes()], [group["label"].to_numpy().tobytes()], [narrow(v)]]
        return pa.table(dict(zip(("cell", "block", "ids", "labels", "data"), out, strict=True)))

    dealt = placed.withColumn("block", F.pmod(F.xxhash64("at"), many).cast("int"))
    lists = dealt.select("cell", "block", "vec_id", "label", "v").groupBy("cell", "block").applyInArrow(pack, "cell int, block int, ids binary, labels binary, data binary")
    return index, cut_lineage(lists, "multi-index-lists")


def narrow(v: np.ndarray) -> bytes:
    """Integers in the narrowest type that holds them all; its width comes first."""
    width = next(w for w in (2, 4, 8) if w == 8 or np.abs(v).max(initial=0) < 1 << (8 * w - 1))
    return bytes([width]) + v.astype(f"<i{width}").tobytes()


def widen(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64).reshape(rows, -1)


def plan_probe(index: MultiIndex, v: np.ndarray, wanted: list[tuple[int, int, int]], probe_rows: int) -> Iterator[int]:
    """The first cells of the walk, until they hold `probe_rows` rows or nothing ahead reaches a window."""
    held, low, high = 0, min(w[0] for w in wanted), max(w[1] for w in wanted)
    for bound, cell, least, most in index.walk(v):
        if held >= probe_rows or bound < low:
            return
        if most >= low and least <= high:
            held += int(index.size.flat[cell])
            yield cell


def plan_rest(index: MultiIndex, v: np.ndarray, wanted: list[tuple[int, int, int]], probe_rows: int) -> Iterator[int]:
    """The cells after those of the probe whose scores can still enter a window at or above its floor."""
    before = set(plan_probe(index, v, wanted, probe_rows))
    stop = min(max(low, floor) for low, _, floor in wanted)
    for bound, cell, least, most in index.walk(v):
        if bound < stop:
            return
        if cell not in before and any(most >= max(low, floor) and least <= high for low, high, floor in wanted):
            yield cell


Plan = Callable[[MultiIndex, np.ndarray, list[tuple[int, int, int]], int], Iterator[int]]


def visit(asks: DataFrame, index: MultiIndex, lists: DataFrame, plan: Plan, same: bool, k: int, probe_rows: int, ask_rows: int) -> DataFrame:
    """`ask, window, vec_id, score`: of each window of each anchor the `k` best rows of every visited block.

    `asks` holds `ask, anchor_id, label, v, windows`; a window is (least score, highest score, floor).
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            chosen: list[list[int]] = []
            for v, windows in zip(matrix(b.column(3), np.int64), b.column(4).to_pylist(), strict=True):
                wanted = [(w["low"], w["high"], w["floor"]) for w in windows if w["low"] <= w["high"]]
                chosen.append(list(plan(index, v, wanted, probe_rows)) if wanted else [])
            row = np.repeat(np.arange(b.num_rows), [len(c) for c in chosen])
            cell = np.array([c for mine in chosen for c in mine], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), *[x.take(pa.array(row)) for x in b.columns]], ["cell", *b.schema.names])

    windows = "windows array<struct<low:long,high:long,floor:long>>"
    visits = asks.select("ask", "anchor_id", "label", "v", "windows").mapInArrow(cells, f"cell int, ask long, anchor_id long, label long, v array<long>, {windows}")

    def pack(group: pa.Table) -> pa.Table:
        cell = group["cell"][0].as_py()
        count = [len(w) for w in group["windows"].to_pylist()]
        flat = [x for w in group["windows"].to_pylist() for x in w]
        spans = np.array([(w["low"], w["high"], w["floor"]) for w in flat], np.int64).reshape(-1, 3)
        one = {
            "cell": pa.array([cell], pa.int32()),
            "blocks": pa.array([list(range(int(index.blocks.flat[cell])))], pa.list_(pa.int32())),
            "asks": [np.stack([group[c].to_numpy() for c in ("ask", "anchor_id", "label")]).tobytes()],
            "vectors": [narrow(matrix(group["v"], np.int64))],
            "counts": [np.array(count, np.int64).tobytes()],
            "spans": [spans.tobytes()],
        }
        return pa.table(one)

    # the anchors of a cell go together, at most about `ask_rows` in one row, to each block of the cell
    chunks = max(1, -(-asks.count() // ask_rows))
    salted = visits.withColumn("chunk", F.pmod(F.xxhash64("ask"), F.lit(chunks)))
    packed = salted.groupBy("cell", "chunk").applyInArrow(pack, "cell int, blocks array<int>, asks binary, vectors binary, counts binary, spans binary")
    # both sides grow with the table: neither may be broadcast on a guess from the size of its source
    met = packed.select("*", F.explode("blocks").alias("block")).drop("blocks").join(lists.hint("merge"), ["cell", "block"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for row in (r for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                ask, anchor, label = np.frombuffer(row["asks"], np.int64).reshape(3, -1)
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                counts, spans = np.frombuffer(row["counts"], np.int64), np.frombuffer(row["spans"], np.int64).reshape(-1, 3)
                first = np.cumsum(counts) - counts
                every = products(widen(row["vectors"], len(ask)), widen(row["data"], len(ids)))
                for i, scores in enumerate(every):
                    mine = spans[first[i] : first[i] + counts[i]]
                    low = np.maximum(mine[:, 0], mine[:, 2])
                    fits = (scores >= low.min()) & (scores <= mine[:, 1].max()) & (ids != anchor[i]) & ((labels == label[i]) == same)
                    if not fits.any():
                        continue
                    near, there = scores[fits], ids[fits]
                    for w in range(len(mine)):
                        at = np.flatnonzero((near >= low[w]) & (near <= mine[w, 1]))
                        at = at[np.lexsort((there[at], -near[at]))[:k]]
                        for column, value in zip(out, (np.full(len(at), ask[i]), np.full(len(at), w), there[at], near[at]), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["ask", "window", "vec_id", "score"])

    return met.mapInArrow(score, "ask long, window long, vec_id long, score long")


def floor_div(number: str, by: int = 100) -> Column:
    """The whole part of a SQL number divided, rounded down (`div` rounds towards zero)."""
    return F.expr(f"({number} - pmod({number}, {by}L)) div {by}L")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ask", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def certified(asks: DataFrame, index: MultiIndex, lists: DataFrame, same: bool, k: int, probe_rows: int, ask_rows: int) -> DataFrame:
    """`ask, window, rank, vec_id, score`: the `k` best of every window, probe and rest together."""
    first = cut_lineage(best(visit(asks, index, lists, plan_probe, same, k, probe_rows, ask_rows), k), "negatives-probe")
    kth = first.where(F.col("rank") == k).groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
    floor = lambda w, i: F.coalesce(F.element_at("kth", i.cast("long")), w["floor"])
    raised = F.transform("windows", lambda w, i: F.struct(w["low"].alias("low"), w["high"].alias("high"), floor(w, i).alias("floor")))
    again = asks.join(kth, "ask", "left").withColumn("windows", raised).drop("kth")
    rest = visit(again, index, lists, plan_rest, same, k, probe_rows, ask_rows)
    return best(first.select("ask", "window", "vec_id", "score").unionByName(rest), k)


def mine(
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    codes: int = 16,
    probe_rows: int = 4096,
    block_rows: int = 2048,
    ask_rows: int = 1024,
    sample: int = 8192,
) -> DataFrame:
    """Hard negatives for `vec_id, label, v` (whole numbers) on both sides; columns as in RESULT.

    A negative's score lies between `low_percent` and `high_percent` of the positive's.
    """
    spark, shape = rows.sparkSession, ["vec_id", "label", "v"]
    rows = cut_lineage(rows.select(*shape), "negatives-rows")
    if not rows.limit(1).count():
        return spark.createDataFrame([], RESULT)
    index, lists = build(rows, codes, block_rows, sample)
    window = F.struct(F.lit(NOTHING).alias("low"), F.lit(-NOTHING).alias("high"), F.lit(NOTHING).alias("floor"))
    asked = anchors.select(F.monotonically_increasing_id().alias("ask"), F.col("vec_id").alias("anchor_id"), "label", "v", F.array(window).alias("windows"))
    asks = cut_lineage(asked, "negatives-asks")
    found = cut_lineage(certified(asks, index, lists, True, positives, probe_rows, ask_rows), "negatives-positives")

    # a window for each positive, in the order of the positives; both ends rounded inwards
    low, high = -floor_div(f"-score * {low_percent}L"), floor_div(f"score * {high_percent}L")
    opened = found.select("ask", "rank", F.struct("rank", low.alias("low"), high.alias("high"), F.lit(NOTHING).alias("floor")).alias("w"))
    opened = opened.groupBy("ask").agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w.dropFields("rank")).alias("windows"))
    hard = certified(asks.drop("windows").join(opened, "ask"), index, lists, False, negatives, probe_rows, ask_rows)
    named = found.select("ask", (F.col("rank") - 1).cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(named, ["ask", "window"]).join(asks.select("ask", "anchor_id"), "ask")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def quantized(table: DataFrame, scale: float = 256.0) -> DataFrame:
    """`vec_id, label, v`: floor(scale * x) of every component of the rows that take part."""
    rows = table.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding"))
    return rows.where(usable).select("vec_id", "label", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x)).alias("v"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3 hard negatives for each of the 5 positives of every anchor (ids divisible by 50), against all rows."""
    rows = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved)
    return mine(rows, rows.where(F.col("vec_id") % 50 == 0))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, r.label = a.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
