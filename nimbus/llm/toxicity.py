"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text is unlabelled, not
clean. A linear classifier over the presence of hashed words and word beginnings
is trained in numpy by the class-prior-corrected risk estimator

    R = pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

whose second term is kept from going negative: a step that would do so climbs
out of it instead. The classifier is fitted on a bounded sample of documents
(`positives`, `unlabelled`); scoring covers every whole text.

Defined results for odd input: null and empty texts have no features and get
the score of the bias alone; documents without an id are scored (they are not
held out and never in the sample); repeated rows get equal scores; with no
positives, every score is the class prior; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nimbus.llm.words import LETTERS, Words, slices

BITS = 20
PREFIXES = (3, 4, 5, 6)


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and word beginning of a batch of texts, with repeats."""
    words = Words(column, LETTERS)
    text = words.text_of_word()
    length = words.end - words.start
    shift = np.uint64(64 - bits)
    found = [(text, words.hashes(seed=1))]
    for p in PREFIXES:
        found.append((text[length > p], words.hashes(seed=10 + p, most=p)[length > p]))
    return np.concatenate([t for t, _ in found]), (np.concatenate([h for _, h in found]) >> shift).astype(np.int64)


def distinct(text: np.ndarray, feature: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Every feature of a text once."""
    both = np.unique((text << bits) | feature)
    return both >> bits, both & ((1 << bits) - 1)


class Classifier:
    """A bias and a weight for each hashed feature."""

    def __init__(self, bias: float, weights: np.ndarray):
        self.bias, self.weights = bias, weights

    def scores(self, column: pa.Array) -> np.ndarray:
        text, feature = features(column)
        known = self.weights[feature] != 0
        text, feature = distinct(text[known], feature[known])
        total = np.bincount(text, self.weights[feature], len(column))
        return 1.0 / (1.0 + np.exp(-np.clip(total + self.bias, -30, 30)))


def select(pos: list[np.ndarray], unl: list[np.ndarray], size: int, prior: float) -> np.ndarray:
    """Features that are more frequent in positives than chance explains for any of the features seen.

    The unlabelled share is corrected for the positives hidden in it; the chance is the Poisson tail
    bound of the count in the positives, held to one false feature among all that are tested.
    """
    p, u = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for total, docs in ((p, pos), (u, unl)):
        for features_ in docs:  # distinct features: each counts once
            total[features_] += 1
    seen = np.flatnonzero(p)  # no other can be more frequent in positives
    p, u = p[seen].astype(np.float64), u[seen].astype(np.float64)
    share_p, share_u = p / len(pos), u / len(unl)
    negative = np.maximum((share_u - prior * share_p) / (1 - prior), 0.5 / len(unl))
    expected = negative * len(pos)
    tail = p * np.log(np.maximum(p, 1e-9) / expected) - p + expected
    return seen[(p > expected) & (tail > np.log(max(1, len(seen))))]


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, bits: int = BITS, rounds: int = 400, rate: float = 0.1, decay: float = 1e-4, beta: float = 0.0) -> Classifier:
    """nnPU with the logistic loss and full-batch Adam steps.

    `pos` and `unl` hold the distinct features of each document.
    """
    weights = np.zeros(1 << bits)
    prior = min(max(prior, 1e-4), 0.9)
    if not pos or not unl:
        return Classifier(float(np.log(prior / (1 - prior))), weights)
    kept = select(pos, unl, 1 << bits, prior)
    place = np.full(1 << bits, -1)
    place[kept] = np.arange(len(kept))

    def rows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        known = [f[f >= 0] for f in (place[d] for d in docs)]
        return np.repeat(np.arange(len(docs)), [len(f) for f in known]), np.concatenate(known), len(docs)

    p, u = rows(pos), rows(unl)
    w, b = np.zeros(len(kept)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)

    def margin(x) -> np.ndarray:
        return np.bincount(x[0], w[x[1]], x[2]) + b

    def gradient(x, d: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(x[1], d[x[0]], len(kept)), d.sum()) / x[2]

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, z)  # noqa: E731  of calling a document toxic; loss(-z) of calling it clean
    for step in range(1, rounds + 1):
        zp, zu = margin(p), margin(u)
        negative = loss(zu).mean() - prior * loss(zp).mean()
        corrected = gradient(u, sigmoid(zu)) - prior * gradient(p, sigmoid(zp))
        # below -beta the estimate overfits: only climb back
        g = prior * gradient(p, -sigmoid(-zp)) + corrected if negative >= -beta else -corrected
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    weights[kept] = w
    # the bias is set so that the mean score of unlabelled text is the class prior
    z, lo, hi = margin(u) - b, -30.0, 30.0
    for _ in range(60):
        b = (lo + hi) / 2
        lo, hi = (b, hi) if sigmoid(z + b).mean() < prior else (lo, b)
    return Classifier(b, weights)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000) -> Classifier:
    """From the labels of documents that are not held out.

    `positives` and `unlabelled` bound the sample: the ids with the smallest hashes.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).collect()[0][0] or 0.0
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.where("toxic = 1").orderBy(*by_hash).limit(positives).select("doc_id", F.lit(1).alias("kind"))
    free = documents.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id")
    ids = ids.unionByName(free.distinct().orderBy(*by_hash).limit(unlabelled).select("doc_id", F.lit(0).alias("kind")))
    # at most positives + unlabelled ids, and one text of each however often it is repeated
    sample = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    sample = sample.groupBy("doc_id", "kind").agg(F.max("text").alias("text")).select("kind", "text", "doc_id")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1):
                text, feature = distinct(*features(b.column(1)))
                cuts = np.searchsorted(text, np.arange(b.num_rows + 1))
                packed = [feature[cuts[i] : cuts[i + 1]].astype("<u4").tobytes() for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(packed, pa.binary())], ["kind", "doc_id", "features"])

    # at most positives + unlabelled rows; read as Arrow and looked at in place
    rows = sample.mapInArrow(found, "kind int, doc_id long, features binary").toArrow()
    return fit(*by_kind(rows), float(prior))


def by_kind(rows: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Features of the positives and of the unlabelled in the order of their ids: views of the table, which is not copied."""
    kinds, packed = rows["kind"].to_pylist(), rows["features"]
    docs: tuple[list, list] = ([], [])
    for i in pc.sort_indices(rows, sort_keys=[("kind", "ascending"), ("doc_id", "ascending")]).to_pylist():
        docs[kinds[i]].append(np.frombuffer(packed[i].as_buffer(), "<u4"))
    return docs[1], docs[0]


def free_name(columns: list[str], name: str = "_score") -> str:
    """The name, or the name with more underscores in front where a column has it (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def score(documents: DataFrame, model: Classifier, name: str = "_score") -> DataFrame:
    """Every row with all its columns and a last column `name`, which the input must not have (`free_name` gives one)."""
    if free_name(documents.columns, name) != name:
        raise ValueError(f"the documents have a column {name!r} of their own")
    shared = documents.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    at = documents.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Classifier(*shared.value)
        for batch in batches:
            for b in slices(batch, at):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(one.scores(b.column(at)))], [*b.schema.names, name])

    return documents.mapInArrow(scored, StructType([*documents.schema.fields]).add(name, "double"))


def op4_toxicity(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Every document with its score and verdict."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted")
    )
