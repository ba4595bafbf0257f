"""Cross-entropy difference of a target and a background n-gram model.

Both models are bigrams over one vocabulary (all words of all documents; a
caller may keep the `vocabulary` most frequent ones, others are one unknown
word then), interpolated with unigrams in the same way:

    p(w | u) = weight * c(u, w) / c(u) + (1 - weight) * (c(w) + 1) / (N + V)

The background counts come from all documents, the target counts from those
that a table of ids names. A document's score is the mean over its words of the
target loss minus the background loss, in nats: the lower, the more like the
target.

How it runs: words and bigrams are named by 64-bit hashes. A slice of documents
counts each of its words and bigrams once and sends the counts to buckets of
hashes. A bucket sums them for both models and gives every slice the sums of
its own words and bigrams; the slice then has all that its losses need. No
table of words or bigrams is held in one place, and a word or bigram in all
documents is one number a slice.

Defined results for odd input: null and empty texts have no words, and losses
and score 0; ids are carried as they are, nulls too, and a null id is never a
target; repeated rows are counted and scored one by one; without any target
document the target model falls back to its unigrams, which are then uniform;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbus.llm.words import M1, M2, Words, mix, slices

UNKNOWN, START = np.uint64(0), np.uint64(1)  # in the place of word hashes
WORD = np.uint64(1)  # the last bit of a key: set for words, not for bigrams
BROADCAST_BYTES = 64 << 20


def with_target(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """`doc_id, text, target`. The ids are broadcast only when they are counted and found to fit."""
    ids = targets.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().withColumn("target", F.lit(True))
    if ids.count() * 32 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    joined = documents.select("doc_id", "text").join(ids, "doc_id", "left")
    return joined.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))


def word_counts(flagged: DataFrame) -> DataFrame:
    """`word, n` over all whole texts."""
    words = F.explode(F.split(F.regexp_replace("text", "[\t-\r]", " "), " "))
    found = flagged.select(words.alias("word")).where("word <> ''")
    return found.groupBy("word").agg(F.count("*").alias("n"))


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0, stored as planes of their bytes and compressed."""
    width = max(1, -(-int(numbers.max()).bit_length() // 8)) if len(numbers) else 1
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]
    return bytes([width]) + len(numbers).to_bytes(8, "little") + pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    width, n = packed[0], int.from_bytes(packed[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.Codec("zstd").decompress(packed[9:], width * n), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.uint64)


def word_keys(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes + M1) | WORD


class Bigrams:
    """Words and distinct bigrams of the texts of a slice; both are counted under 64-bit keys.

    `hashes` are the distinct words, `number` the place of each word of the texts in them and
    `held` the number of words of each text. Words come first among the keys, the start of a text
    after them, then the bigrams; `order` sorts the keys.
    """

    def __init__(self, hashes: np.ndarray, number: np.ndarray, held: np.ndarray):
        first = np.r_[0, np.cumsum(held)[:-1]][held > 0] if len(held) else np.zeros(0, np.int64)
        before = np.empty_like(number)
        before[1:] = number[:-1]
        before[first] = len(hashes)
        self.held, self.number, self.size, self.starts = held, number, len(hashes) + 1, first
        pair, self.of = np.unique(before * self.size + number, return_inverse=True)
        self.before, self.word = pair // self.size, pair % self.size
        named = np.r_[hashes, START]
        self.keys = np.r_[word_keys(named), mix(mix(named[self.before] + M2) * M1 + named[self.word]) & ~WORD]
        self.order = np.argsort(self.keys)

    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.held)), self.held)

    def counts(self, used: np.ndarray) -> np.ndarray:
        """How often each key is in the texts that are `used`."""
        inside = used[self.text()]
        single = np.bincount(self.number[inside], minlength=self.size)
        single[-1] = np.count_nonzero(inside[self.starts])
        return np.r_[single, np.bincount(self.of[inside], minlength=len(self.word))]

    def losses(self, counts: np.ndarray, totals: list[int], size: int, weight: float) -> np.ndarray:
        """(2, texts): the summed losses under both models; `counts` (2, keys) are over all documents."""
        out = np.empty((2, len(self.held)))
        for i, total in enumerate(totals):
            single, together = counts[i, : self.size], counts[i, self.size :]
            p = weight * together / np.maximum(single[self.before], 1) + (1 - weight) * (single[self.word] + 1) / (total + size)
            out[i] = np.bincount(self.text(), -np.log(p)[self.of], len(self.held))
        return out


SENT = "bucket int, slice long, keys binary, n binary, n_target binary, ids binary, known binary, held binary, hashes binary, number binary"
HOME = ["ids", "known", "held", "hashes", "number"]


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))]))


def _sliced(batch: pa.RecordBatch, known: np.ndarray | None, place: int, buckets: int) -> pa.RecordBatch:
    """The keys of a slice and their counts, a row for each bucket; the slice itself rides with one of them."""
    words = Words(batch.column(1))
    hashes = words.hashes()
    if known is not None:
        hashes[~np.isin(hashes, known)] = UNKNOWN
    distinct, number, times = np.unique(hashes, return_inverse=True, return_counts=True)
    ranked = np.argsort(-times, kind="stable")  # small numbers for frequent words take less room
    rank = np.empty_like(ranked)
    rank[ranked] = np.arange(len(ranked))
    distinct, number = distinct[ranked], rank[number]
    held = np.diff(words.first)
    found = Bigrams(distinct, number, held)
    keys = found.keys[found.order]
    n = found.counts(np.ones(len(held), bool))[found.order]
    n_target = found.counts(batch.column(2).to_numpy(zero_copy_only=False))[found.order]
    cuts = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
    home, rows = int(mix(np.array([place], np.uint64))[0]) % buckets, []
    for i in range(buckets):
        lo, hi = cuts[i : i + 2]  # every slice asks every bucket, which tells its number of words
        rows.append({"bucket": i, "slice": place, "keys": pack(np.diff(keys[lo:hi], prepend=np.uint64(0))), "n": pack(n[lo:hi]), "n_target": pack(n_target[lo:hi])})
        if i == home:
            ids = batch.column(0)
            rows[-1] |= {
                "ids": ids.fill_null(0).to_numpy().tobytes(), "known": ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), "held": pack(held),
                "hashes": pack(np.diff(distinct, prepend=np.uint64(0))), "number": pack(number),
            }
    return _batch(rows, SENT)


def _sent(flagged: DataFrame, known: np.ndarray | None, buckets: int) -> DataFrame:
    shared = flagged.sparkSession.sparkContext.broadcast(known)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            for b in slices(batch, 1):
                yield _sliced(b, shared.value, place, buckets)
                place += 1

    return flagged.mapInArrow(send, SENT)


SUMS = "bucket int, slice long, words long, total long, total_target long, n binary, n_target binary, ids binary, known binary, held binary, hashes binary, number binary"


def _summed(table: pa.Table) -> pa.Table:
    """Sums the counts of each key of a bucket over all slices; every slice gets those of its keys, in its order.

    `words` are the bucket's distinct words, `total` and `total_target` how often they occur.
    """
    keys = [np.cumsum(unpack(x.as_py()), dtype=np.uint64) for x in table["keys"]]
    cuts = np.cumsum([0, *map(len, keys)])
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(keys)])
    keys = keys[first]
    start, unknown = word_keys(np.array([START, UNKNOWN]))
    word = (keys & WORD == WORD) & (keys != start)
    out = table.select(["bucket", "slice", *HOME]).to_pylist()
    words = int(np.count_nonzero(word & (keys != unknown)))
    for name, total in (("n", "total"), ("n_target", "total_target")):
        counts = np.concatenate([unpack(x.as_py()) for x in table[name]])
        sums = np.add.reduceat(counts[order], first) if len(first) else counts
        counts[order] = np.repeat(sums, times)
        for x, lo, hi in zip(out, cuts[:-1], cuts[1:], strict=True):
            x |= {"words": words, total: int(sums[word].sum()), name: pack(counts[lo:hi])}
    return pa.Table.from_batches([_batch(out, SUMS)])


RESULT = "doc_id long, n_words long, background_loss double, target_loss double, score double"


def _scored(table: pa.Table, weight: float) -> pa.Table:
    """The documents of a slice, from the counts of its keys in all buckets."""
    rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
    home = next(r for r in rows if r["ids"] is not None)
    held = unpack(home["held"]).astype(np.int64)
    found = Bigrams(np.cumsum(unpack(home["hashes"]), dtype=np.uint64), unpack(home["number"]).astype(np.int64), held)
    counts = np.empty((2, len(found.keys)))
    for i, name in enumerate(("n", "n_target")):
        counts[i, found.order] = np.concatenate([unpack(r[name]) for r in rows])
    totals = [sum(r[c] for r in rows) for c in ("total", "total_target")]
    size = sum(r["words"] for r in rows) + 1  # one for the unknown word
    mean = found.losses(counts, totals, size, weight) / np.maximum(held, 1)
    ids = pa.array(np.frombuffer(home["ids"], np.int64), mask=~np.frombuffer(home["known"], bool))
    return pa.table([ids, pa.array(held), pa.array(mean[0]), pa.array(mean[1]), pa.array(mean[1] - mean[0])], names=["doc_id", "n_words", "background_loss", "target_loss", "score"])


def score(documents: DataFrame, targets: DataFrame, vocabulary: int | None = None, weight: float = 0.75, bucket_bytes: int = 16 << 20) -> DataFrame:
    """`doc_id, n_words, background_loss, target_loss, score` of every row."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    flagged = with_target(documents, targets)
    known = None
    if vocabulary is not None:  # bounded by the caller
        top = word_counts(flagged).orderBy(F.desc("n"), "word").limit(vocabulary).select("word")
        known = Words(top.toArrow().column(0).combine_chunks()).hashes()
    nbytes = documents.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    buckets = max(16, -(-nbytes // bucket_bytes))
    sums = _sent(flagged, known, buckets).groupBy("bucket").applyInArrow(_summed, SUMS)
    return sums.groupBy("slice").applyInArrow(lambda t: _scored(t, weight), RESULT)


def op5_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored against a target model of the documents labelled as of good quality."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(documents, labels.where("quality = 1").select("doc_id"))
