"""Alignment of two tokenizers over one corpus by divide and conquer.

Every text is encoded by both tokenizers; the byte offsets where tokens end are
two ascending lists. An interval of tokens is split at a common end near its
middle, found by bisecting the other list, and both halves go on in the same
way; an interval without a common end inside is a leaf group. All intervals of
a slice of documents take their steps together (numpy), so the depth is that of
the longest document, not the number of tokens.

Two token occurrences are linked when their byte ranges overlap. Documents are
counted per linked id pair over the whole corpus: every slice sends each of its
pairs once with the number of its documents, Spark sums them, and the sums go
back to the slices by joins on the pair and on the slice.

Defined results for odd input: texts null, empty, or changed by one of the
tokenizers (joined token bytes are not a space and the text) have no tokens and
all their numbers are 0; a null doc_id is carried; repeated rows are documents
of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbus.llm.packing import Encoder, byte_letters, tokenizer_json
from nimbus.llm.words import slices
from nimbus.session import unique_scratch

ALIGNED = "slice long, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, codes binary, pairs array<long>, pair_docs array<long>"
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"


class Side:
    """One tokenizer: ids of texts, and the bytes that every id stands for."""

    bytes_of: list[bytes]

    def __init__(self) -> None:
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def spell(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class ByteSide(Side):
    """A byte-level BPE file, given a space and the text; special strings in a text are plain text."""

    def __init__(self, given: str):
        self.encoder = Encoder(given)
        self.encoder.tokenizer.encode_special_tokens, self.encoder.marks = True, []
        parsed, letters = json.loads(given), byte_letters()
        special = {t["id"]: t["content"].encode() for t in parsed.get("added_tokens", [])}
        words = {i: w for w, i in parsed["model"]["vocab"].items()}
        self.bytes_of = [special[i] if i in special else bytes(letters[c] for c in words.get(i, "")) for i in range(max([*words, *special]) + 1)]
        super().__init__()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(self.encoder.encode(" " + t), "<u4").tolist() for t in texts]


class PieceSide(Side):
    """A piece model, given the text; it puts the space in front itself."""

    def __init__(self, given: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=given)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        super().__init__()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


NEAR_STEPS = 8  # places next to the middle that are tried one by one; beyond, rings of doubling width


def ring(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray, away: int) -> np.ndarray:
    """For each interval the common end that is nearest to its middle, at `away` places or more; -1 if there is none."""
    found, middle = np.full(len(lo), -1, np.int64), (lo + hi) // 2
    live, near, far = np.arange(len(lo)), away, 2 * away
    while len(live):
        step = np.arange(near, far)
        place = middle[live][:, None] + np.concatenate([step, -step])[None, :]
        inside = (place >= lo[live][:, None]) & (place <= hi[live][:, None])
        owner, which = np.nonzero(inside)
        ends = a[place[owner, which]]
        hit = b[np.minimum(np.searchsorted(b, ends), len(b) - 1)] == ends
        owner, place = owner[hit], place[owner[hit], which[hit]]
        best = np.lexsort((place, np.abs(place - middle[live[owner]]), owner))
        first, at = np.unique(owner[best], return_index=True)
        found[live[first]] = place[best][at]
        rest = (found[live] < 0) & ((middle[live] - far >= lo[live]) | (middle[live] + far <= hi[live]))
        live, near, far = live[rest], far, 2 * far
    return found


def common_ends(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True for the ends `a` that are in `b` too, by divide and conquer.

    Both lists ascend; `first[i]:first[i + 1]` are the ends in `a` of text i, whose
    last one is common by construction. All intervals take one step a round: they
    bisect `b` for one end near their middle, and split where it is found.
    """
    cut = np.zeros(len(a), bool)
    last = first[1:][np.diff(first) > 0] - 1
    cut[last] = True
    # an interval holds the candidates lo..hi (its own last end is known); they stay in ascending order
    lo, hi, step = first[:-1][np.diff(first) > 0], last - 1, np.zeros(len(last), np.int64)
    while True:
        live = lo <= hi
        lo, hi, step = lo[live], hi[live], step[live]
        if not len(lo):
            return cut
        # the middle, then the places next to it in turn on both sides
        place = (lo + hi) // 2 + np.where(step & 1, (step + 1) >> 1, -(step >> 1))
        inside = (place >= lo) & (place <= hi)
        ends = a[np.where(inside, place, lo)]
        hit = inside & (b[np.minimum(np.searchsorted(b, ends), len(b) - 1)] == ends)
        far = np.flatnonzero(~hit & (step + 1 >= NEAR_STEPS))
        if len(far):
            at = ring(a, b, lo[far], hi[far], NEAR_STEPS // 2)
            place[far], hit[far] = at, at >= 0
            hi[far[at < 0]] = lo[far[at < 0]] - 1  # no common end inside: a leaf
        cut[place[hit]] = True
        # a split interval becomes two, any other tries its next place
        wide = np.empty((3, 2 * len(lo)), np.int64)
        wide[:, 0::2] = lo, np.where(hit, place - 1, hi), np.where(hit, 0, step + 1)
        wide[:, 1::2] = np.where(hit, place + 1, 1), np.where(hit, hi, 0), np.zeros_like(step)
        lo, hi, step = wide


def pack_codes(codes: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending codes and how often each occurs, as bytes."""
    step = np.diff(codes, prepend=0).astype("<u4")
    planes = np.stack([step, times.astype("<u4")]).view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1)
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack_codes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(2, 4, -1)
    step, times = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[..., 0].astype(np.int64)
    return np.cumsum(step), times


class Slice:
    """The aligned documents of one slice: ids of both sides, groups and linked pairs."""

    def __init__(self, texts: list[str | None], a: Side, b: Side):
        given = [t or "" for t in texts]
        ids_a, ids_b = a.encode(given), b.encode(given)
        for i, t in enumerate(given):
            raw = b" " + t.encode()
            if not t or a.spell(ids_a[i]) != raw or b.spell(ids_b[i]) != raw:
                ids_a[i], ids_b[i] = [], []
        self.n_a, self.n_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
        self.ids_a, self.ids_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (ids_a, ids_b))
        self.first_a, self.first_b = np.r_[0, np.cumsum(self.n_a)], np.r_[0, np.cumsum(self.n_b)]
        self.ends_a, self.ends_b = np.cumsum(a.size[self.ids_a]), np.cumsum(b.size[self.ids_b])

        self.cut_a = common_ends(self.ends_a, self.ends_b, self.first_a)
        self.cut_b = np.zeros(len(self.ids_b), bool)
        self.cut_b[np.searchsorted(self.ends_b, self.ends_a[self.cut_a])] = True
        self.doc_a = np.repeat(np.arange(len(texts)), self.n_a)
        self.n_groups = np.bincount(self.doc_a[self.cut_a], minlength=len(texts))
        # inside a group no two ends are equal, so every end of either side closes one overlap
        self.n_links = self.n_a + self.n_b - self.n_groups

    def groups(self, names_a: list[bytes], names_b: list[bytes]) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of every document. `names_a` holds `id,` and then `id|` of all ids, `names_b` `id,` and `id;`."""
        of_a, of_b = np.cumsum(self.cut_a) - self.cut_a, np.cumsum(self.cut_b) - self.cut_b
        a_in, b_in = np.bincount(of_a, minlength=1), np.bincount(of_b, minlength=1)
        place_a = np.arange(len(of_a)) + (np.cumsum(b_in) - b_in)[of_a]
        place_b = np.arange(len(of_b)) + np.cumsum(a_in)[of_b]
        half_a, half_b = len(names_a) // 2, len(names_b) // 2
        word = np.zeros(len(of_a) + len(of_b), np.int64)
        word[place_a] = self.ids_a + half_a * self.cut_a
        word[place_b] = len(names_a) + self.ids_b + half_b * self.cut_b
        names = names_a + names_b
        spans = self.first_a + self.first_b
        return [b"".join(map(names.__getitem__, word[i:j].tolist()))[:-1].decode() for i, j in zip(spans, spans[1:], strict=False)]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, id of a << 32 | id of b) of every overlap."""
        ends = np.concatenate([self.ends_a, self.ends_b[~self.cut_b]])
        ends.sort(kind="stable")
        at_a, at_b = np.searchsorted(self.ends_a, ends), np.searchsorted(self.ends_b, ends)
        return self.doc_a[at_a], self.ids_a[at_a] << 32 | self.ids_b[at_b]


def align(documents: DataFrame, a_json: str, b_model: bytes, slice_bytes: int = 4_000_000) -> DataFrame:
    """Per document the numbers of tokens, groups and links, the groups, and its pairs as codes of its slice.

    The first document of each slice carries the slice's pairs and in how many of its documents each is linked.
    """
    shared = documents.sparkSession.sparkContext.broadcast((a_json, b_model))  # two vocabulary files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = ByteSide(shared.value[0]), PieceSide(shared.value[1])
        names_a = [f"{i}{mark}".encode() for mark in ",|" for i in range(len(a.size))]
        names_b = [f"{i}{mark}".encode() for mark in ",;" for i in range(len(b.size))]
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, slice_bytes):
                s = Slice(part.column(1).to_pylist(), a, b)
                doc, pair = s.links()
                code, pairs = pd.factorize(pair)
                held, times = np.unique(doc * (len(pairs) + 1) + code, return_counts=True)
                of, code = np.divmod(held, len(pairs) + 1)
                cuts = np.searchsorted(of, np.arange(part.num_rows + 1))
                codes = [pack_codes(code[i:j], times[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
                n, only_first = part.num_rows, lambda x, n=part.num_rows: pa.array([x] + [None] * (n - 1), pa.list_(pa.int64()))
                columns = [
                    pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)), part.column(0), pa.array(s.n_a), pa.array(s.n_b),
                    pa.array(s.n_groups.astype(np.int64)), pa.array(s.n_links), pa.array(s.groups(names_a, names_b), pa.string()),
                    pa.array(codes, pa.binary()), only_first(pairs), only_first(np.bincount(code, minlength=len(pairs))),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ALIGNED.split(", ")])
                number += 1

    return documents.select("doc_id", "text").mapInArrow(run, ALIGNED)


def slice_pairs(aligned: DataFrame) -> DataFrame:
    """`slice, code, pair, docs`: each pair of each slice, with the number of its documents that hold it."""
    held = aligned.where(F.col("pairs").isNotNull()).select("slice", F.posexplode(F.arrays_zip("pairs", "pair_docs")).alias("code", "x"))
    return held.select("slice", "code", F.col("x.pairs").alias("pair"), F.col("x.pair_docs").alias("docs"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """`pair, a_id, b_id, docs`: how many documents of the corpus hold the pair linked."""
    counts = slice_pairs(aligned).groupBy("pair").agg(F.sum("docs").alias("docs"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a_id"), b_id.cast("int").alias("b_id"), "docs")


def with_counts(aligned: DataFrame) -> DataFrame:
    """Adds `n_best` and `count_sum` to stored aligned documents."""
    counts = pair_counts(aligned)
    best = counts.groupBy("a_id").agg(F.max("docs").alias("most"))
    judged = counts.join(best, "a_id").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    back = slice_pairs(aligned).drop("docs").join(judged, "pair").select(F.col("slice").alias("of"), "code", "docs", "best")
    docs = aligned.select("slice", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "codes")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        number = right["code"].to_numpy()
        count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        count[number], best[number] = right["docs"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for raw in left["codes"]:
            code, times = unpack_codes(raw.as_py())
            n_best.append(int(times @ best[code]))
            count_sum.append(int(times @ count[code]))
        out = left.drop_columns(["slice", "at", "codes"])
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    return docs.groupBy("slice").cogroup(back.groupBy("of")).applyInArrow(add_up, COUNTED)


def files(a_path: str | None = None, b_path: str | None = None) -> tuple[str, bytes]:
    """Both tokenizer files, read once on the driver; by default the public byte-level and piece files."""
    if b_path is None:
        import public_tokenizers

        b_path = public_tokenizers.path("piece_bpe_32k.model")
    with open(b_path, "rb") as f:
        return tokenizer_json(a_path), f.read()


def store(aligned: DataFrame) -> DataFrame:
    """The aligned documents written once to the shared folder, so that no text is encoded twice."""
    path = unique_scratch(aligned.sparkSession, "aligned")
    aligned.write.option("compression", "zstd").parquet(path)
    return aligned.sparkSession.read.schema(aligned.schema).parquet(path)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` aligned between the byte-level and the piece tokenizer, with corpus-wide pair counts."""
    found = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), *files())
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return with_counts(store(found.withColumn("groups", digest))).withColumnRenamed("groups", "groups_sha256")
