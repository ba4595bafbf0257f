"""Substring deduplication on the de Bruijn graph of word windows.

A window of `k` words is an edge from its first k-1 words to its last k-1. An
edge that occurs in several documents is named by its first source coordinate:
the smallest doc_id that holds it and the place in that document. Consecutive
edges of a document whose source coordinates are consecutive too have no branch
between them and compact into one path; the coordinates of both ends and a
second hash of every edge verify it. Every word on a path that another,
smaller document holds is removed.

How it runs: documents are dealt into blocks of a bounded size (`block_bytes`
of text). Two rounds of one job find what blocks have in common, both as a
join through buckets of hashes: a block sends each of its distinct values
once, however many of its documents share it, so a passage in a third of all
documents is one row a block. Round one sends a minimizer for every window
(the smallest hash of its 6-word parts; equal windows have equal minimizers),
round two the edges whose minimizer is in two documents or more. The answers
go back to the blocks, which compact the paths and cut the words.

Defined results for odd input: null and empty texts have no words and are
returned unchanged; a text shorter than `k` words loses nothing; rows without
a doc_id are returned unchanged and take from nobody; rows that share a
doc_id do not take from each other; an empty table gives an empty result; other
columns pass through `dedup` untouched, whatever their names (the working
columns start with `_sd_`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from nimbus.llm.words import Words, window_hashes, window_text

PART = 6  # words of the parts that minimizers are taken from
BIG = np.iinfo(np.int64).max


class Block:
    """The words of a block of documents in the order of their ids, and their windows."""

    def __init__(self, table: pa.Table, k: int):
        ids = table["doc_id"].cast(pa.int64())
        # the order must be the same each time the block is read
        order = pc.sort_indices(pa.table({"id": ids, "text": table["text"]}), sort_keys=[("id", "ascending"), ("text", "ascending")])
        self.table = table.take(order)
        ids = ids.take(order).combine_chunks()
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        text = self.table["text"].combine_chunks()
        self.words = Words(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text)
        self.k = k
        self.hash = self.words.hashes()
        # windows of rows with an id
        self.start, self.text = window_text(self.words.first, k, len(self.hash))
        if not self.known.all():
            keep = self.known[self.text]
            self.start, self.text = self.start[keep], self.text[keep]

    def minimizers(self) -> np.ndarray:
        """For every window, the smallest hash of its parts of PART words."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        part = min(PART, self.k)
        h = window_hashes(self.hash, part, seed=3)
        span, width = self.k - part + 1, 1
        low = h
        while width < span:  # minimum over `width` parts, doubled up to the window
            step = min(width, span - width)
            low = np.minimum(low[: len(low) - step], low[step:])
            width += step
        return low[self.start]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of every window."""
        one = window_hashes(self.hash, self.k, seed=1)
        two = window_hashes(self.hash, self.k, seed=7) >> np.uint64(32)
        return (one[self.start], two[self.start].astype(np.uint32)) if len(self.start) else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))

    def place(self, at: np.ndarray) -> np.ndarray:
        """The window's place in its document, in words."""
        return self.start[at] - self.words.first[:-1][self.text[at]]


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group starts) of values sorted by both hashes; ties keep their order."""
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    same = a[1:] == a[:-1]
    if np.any(same & (b[1:] != b[:-1])):
        order = np.lexsort((np.arange(len(one)), two, one))
        a, b = one[order], two[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return order, np.flatnonzero(np.r_[True, ~same]) if len(a) else np.zeros(0, np.int64)


SENT = "bucket int, block long, one binary, two binary, doc binary, last binary, place binary"
ANSWERED = "block long, bucket int, at binary, doc binary, place binary"


def _values(block: Block, one: np.ndarray, two: np.ndarray, at: np.ndarray, buckets: int) -> list[tuple]:
    """What a block sends of the values `one, two` of its windows `at`: for each bucket the distinct
    values, their first window and the last document that holds them."""
    order, first = _distinct(one, two)
    if not len(first):
        return []
    last = block.text[at[order[np.r_[first[1:], len(order)] - 1]]]
    head = order[first]
    by_text = np.argsort(head)  # in the order of the text, so that ids and places rise
    head, last = head[by_text], last[by_text]
    bucket = (one[head] & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets
    sort = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[sort], np.arange(buckets + 1))
    return [(b, head[sort[cuts[b] : cuts[b + 1]]], last[sort[cuts[b] : cuts[b + 1]]]) for b in range(buckets) if cuts[b + 1] > cuts[b]]


def _differences(x: np.ndarray) -> bytes:
    return np.diff(x, prepend=np.int64(0)).astype(np.int64).tobytes()


def _summed(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, np.int64))


def _sent(block_id: int, block: Block, one: np.ndarray, two: np.ndarray, at: np.ndarray, buckets: int) -> pa.Table:
    rows = []
    for b, head, last in _values(block, one, two, at, buckets):
        doc = block.ids[block.text[at[head]]]
        rows.append((b, block_id, one[head].tobytes(), two[head].tobytes(), _differences(doc), _differences(block.ids[last] - doc), _differences(block.place(at[head]))))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "block", "one", "two", "doc", "last", "place"])


def _answers(table: pa.Table) -> pa.Table:
    """For each block that sent to this bucket: which of its values several documents hold, and their
    first source coordinate."""
    rows = table.sort_by("block").to_pylist()
    one = np.concatenate([np.frombuffer(r["one"], np.uint64) for r in rows])
    two = np.concatenate([np.frombuffer(r["two"], np.uint32) for r in rows])
    doc = np.concatenate([_summed(r["doc"]) for r in rows])
    last = doc + np.concatenate([_summed(r["last"]) for r in rows])
    place = np.concatenate([_summed(r["place"]) for r in rows])
    order, first = _distinct(one, two)
    least = np.minimum.reduceat(doc[order], first)
    most = np.maximum.reduceat(last[order], first)
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
    at_least = np.where(doc[order] == least[group], place[order], BIG)
    where = np.minimum.reduceat(at_least, first)
    of = np.empty(len(order), np.int64)
    of[order] = group
    out, lo = [], 0
    for r in rows:
        n = len(r["one"]) // 8
        g = of[lo : lo + n]
        # a value is worth an answer where its block holds it in a document after the first
        hit = np.flatnonzero((most[g] > least[g]))
        if len(hit):
            out.append((r["block"], r["bucket"], _differences(hit), _differences(least[g][hit]), _differences(where[g][hit])))
        lo += n
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3]
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "bucket", "at", "doc", "place"])


def _heard(block: Block, one: np.ndarray, two: np.ndarray, at: np.ndarray, buckets: int, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which of the windows `at` have an answer, its document, its place)."""
    sent = {b: head for b, head, _ in _values(block, one, two, at, buckets)}
    heads, docs, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in answers.to_pylist():
        heads.append(sent[r["bucket"]][_summed(r["at"])])
        docs.append(_summed(r["doc"]))
        places.append(_summed(r["place"]))
    head, doc, place = np.concatenate(heads), np.concatenate(docs), np.concatenate(places)
    # every window with the value of an answered first window
    order, first = _distinct(one, two)
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
    answer = np.full(len(first), -1)
    answer[group[head]] = np.arange(len(head))
    mine = answer[group]
    hit = np.flatnonzero(mine >= 0)
    return hit, doc[mine[hit]], place[mine[hit]]


def _blocks(documents: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    size = documents.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    n = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))
    parts = max(1, min(n, max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 4)))
    return documents.withColumn("_sd_block", block).repartition(parts, "_sd_block"), max(1, n)


def _cut(documents: DataFrame, k: int, block_bytes: int, schema: StructType, finish: Callable) -> DataFrame:
    """Both rounds, then `finish(block, windows, source documents, source places)` for every block."""
    blocks, n = _blocks(documents, block_bytes)
    buckets = max(16, n // 2)
    zero = lambda x: np.zeros(len(x), np.uint32)

    def send_minimizers(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table, k)
        m = block.minimizers()
        return _sent(key[0].as_py(), block, m, zero(m), np.arange(len(m)), buckets)

    def candidates(block: Block, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = block.minimizers()
        at, _, _ = _heard(block, m, zero(m), np.arange(len(m)), buckets, answers)
        one, two = block.edges()
        return one[at], two[at], at

    def send_edges(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent(0, None, np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), buckets)
        block = Block(table, k)
        return _sent(key[0].as_py(), block, *candidates(block, answers), buckets)

    def close(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table.drop_columns(["_sd_block"]), k)
        first = answers.filter(pc.equal(answers["round"], 1)).drop_columns(["round"])
        second = answers.filter(pc.equal(answers["round"], 2)).drop_columns(["round"])
        one, two, at = candidates(block, first)
        hit, doc, place = _heard(block, one, two, at, buckets, second)
        at = at[hit]
        taken = doc < block.ids[block.text[at]]
        return finish(block, at[taken], doc[taken], place[taken])

    lean = blocks  # all columns: one exchange serves all three readers
    sent = lean.groupBy("_sd_block").applyInArrow(send_minimizers, SENT)
    first = sent.groupBy("bucket").applyInArrow(_answers, ANSWERED)
    edges = lean.groupBy("_sd_block").cogroup(first.groupBy("block")).applyInArrow(send_edges, SENT)
    second = edges.groupBy("bucket").applyInArrow(_answers, ANSWERED)
    both = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    return blocks.groupBy("_sd_block").cogroup(both.groupBy("block")).applyInArrow(close, schema)


def paths(block: Block, at: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number of edges) of the compacted paths among the windows `at`, in their order: an
    edge continues a path if it follows in its document and in the source document."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    goes_on = (np.diff(at) == 1) & (np.diff(block.text[at]) == 0) & (np.diff(block.start[at]) == 1)
    goes_on &= (np.diff(doc) == 0) & (np.diff(place) == 1)
    first = np.flatnonzero(np.r_[True, ~goes_on])
    return first, np.diff(np.r_[first, len(at)])


def _removed(block: Block, at: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word is removed, number of paths of each document)."""
    first, edges = paths(block, at, doc, place)
    cover = np.zeros(len(block.words) + 1, np.int64)
    begin = block.start[at[first]]
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + edges + block.k - 1, -1)
    return np.cumsum(cover[:-1]) > 0, np.bincount(block.text[at[first]], minlength=len(block.ids))


def _kept(block: Block, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the kept words of every document, joined by one space."""
    w = block.words
    keep = np.flatnonzero(~removed)
    text = np.searchsorted(w.first, keep, "right") - 1
    more = np.r_[text[1:] == text[:-1], False] if len(keep) else np.zeros(0, bool)
    step = np.zeros(len(w.raw) + 1, np.int8)
    step[w.start[keep]] += 1
    step[w.end[keep]] -= 1
    mask = np.cumsum(step[:-1], dtype=np.int8) > 0
    raw = w.raw.copy()
    gap = w.end[keep[more]]  # a kept word follows in the same document, so a white space is here
    mask[gap], raw[gap] = True, 0x20
    return raw[mask], np.r_[0, np.cumsum(mask)][w.offsets]


def _digest(block: Block, at: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.Table:
    removed, n_paths = _removed(block, at, doc, place)
    raw, offsets = _kept(block, removed)
    view = memoryview(raw.tobytes())
    total = np.r_[0, np.cumsum(removed)]
    return pa.table({
        "doc_id": block.table["doc_id"].cast(pa.int64()),
        "n_words": np.diff(block.words.first),
        "n_removed": np.diff(total[block.words.first]),
        "kept_sha256": [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)],
        "n_paths": n_paths,
    })


def digest(documents: DataFrame, k: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """`doc_id, n_words, n_removed, kept_sha256, n_paths` of every row."""
    schema = StructType()
    for name, kind in (("doc_id", LongType()), ("n_words", LongType()), ("n_removed", LongType()), ("kept_sha256", StringType()), ("n_paths", LongType())):
        schema = schema.add(name, kind)
    return _cut(documents.select("doc_id", "text"), k, block_bytes, schema, _digest)


def dedup(documents: DataFrame, k: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """The documents without repeated words: where some go, the text is the kept words joined by one
    space (and `n_chars`, if there, its length); all other rows and columns are unchanged."""
    names, kinds = documents.columns, documents.schema

    def rewrite(block: Block, at: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.Table:
        removed, _ = _removed(block, at, doc, place)
        raw, offsets = _kept(block, removed)
        total = np.r_[0, np.cumsum(removed)]
        changed = pa.array(np.diff(total[block.words.first]) > 0)
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw.tobytes())])
        text = block.table["text"].combine_chunks()
        new = pc.if_else(changed, data.cast(pa.large_string()).cast(text.type), text)
        out = block.table.set_column(block.table.schema.get_field_index("text"), "text", new)
        if "n_chars" in names:
            length = pc.utf8_length(new).cast(block.table["n_chars"].type)
            out = out.set_column(out.schema.get_field_index("n_chars"), "n_chars", pc.if_else(changed, length, block.table["n_chars"].combine_chunks()))
        return out.select(names)

    return _cut(documents, k, block_bytes, StructType(list(kinds.fields)), rewrite)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of `documents` covered by 13-word windows that a smaller document holds too, removed."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), placed AS (
  SELECT row_id, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words
), windows AS (
  SELECT *, list(word) OVER (PARTITION BY row_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS win FROM placed
), least AS (
  SELECT win, min({'doc': doc_id, 'pos': pos}) AS first FROM windows WHERE len(win) = 13 GROUP BY win
), judged AS (
  SELECT w.row_id, w.word, w.pos, coalesce(l.first.doc < w.doc_id, false) AS earlier, l.first AS first
  FROM windows w LEFT JOIN least l ON len(w.win) = 13 AND l.win = w.win
), covered AS (
  SELECT *, bool_or(earlier) OVER (PARTITION BY row_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone,
    earlier AND NOT coalesce(lag(earlier) OVER o AND lag(first.doc) OVER o = first.doc AND lag(first.pos) OVER o = first.pos - 1, false) AS begins
  FROM judged WINDOW o AS (PARTITION BY row_id ORDER BY pos)
), kept AS (
  SELECT row_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_paths, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM covered GROUP BY row_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256,
  CAST(coalesce(k.n_paths, 0) AS BIGINT) AS n_paths
FROM words w LEFT JOIN kept k USING (row_id)
"""
