"""Packing token sequences by best-fit decreasing.

Every document is tokenized inside Arrow batches and ends with an end id; a
document longer than a window is first cut into full windows. The pieces are
dealt into groups of a bounded size by a hash of their row number, and each
group is packed by best-fit decreasing: a segment tree indexed by remaining
capacity finds the tightest open window that still has room.

Defined results for odd input: a null text counts as empty and gives one piece
that holds the end id alone; a null doc_id is carried as null; repeated rows
are packed once each; an empty table gives no pieces; other columns of the
input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEQUENCE = 2048
END_ID = 1
# Characters whose class (letter, number, space, other) no library disputes. A text of these alone may be
# encoded by the faster library; any other goes to `tokenizers`.
PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027\u20ac]")
# the word pattern of byte-level BPE files; a fixed value
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level BPE file writes for each byte: printable Latin bytes as they are, the
    others as the letters from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids (little-endian unsigned 32-bit) of texts by a tokenizer file.

    For a plain byte-level BPE file, `tiktoken` with the file's own vocabulary gives the ids that
    `tokenizers` gives, at a fraction of the time; it is used for texts of undisputed characters.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.fast, self.marks = None, []
        given = json.loads(tokenizer_json)
        before = given.get("pre_tokenizer") or {}
        byte_level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if byte_level and given["model"]["type"] == "BPE" and not given.get("normalizer") and not given["model"].get("ignore_merges"):
            import tiktoken

            self.marks = [t["content"] for t in given.get("added_tokens", [])]
            letters = byte_letters()
            ranks = {bytes(letters[c] for c in w): i for w, i in given["model"]["vocab"].items() if w not in self.marks}
            self.fast = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or PLAIN.search(text) or any(m in text for m in self.marks):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(documents: DataFrame, tokenizer_json: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Full windows and one rest of every document: `doc_id, start, length, ids_crc32, doc_tokens`."""
    shared = documents.sparkSession.sparkContext.broadcast(tokenizer_json)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        end = np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encoder.encode(text.as_py() or "") + end
                total = len(raw) // 4
                for start in range(0, total, size):
                    part = raw[4 * start : 4 * (start + size)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), total))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return documents.select("doc_id", "text").mapInArrow(cut, PIECES)


class OpenWindows:
    """Windows by remaining capacity; a segment tree over capacities counts the open ones."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) with the least room of at least `need`, removed; None if there is none."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            # up to the first right sibling that holds a window, then down its left side
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.stacks[room].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of every length, longest first, each into the tightest open window."""
    windows, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened, free = 0, OpenWindows(size)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room, window = free.take(n) or (size, opened)
        opened += window == opened
        windows[i], offsets[i] = window, size - room
        if room > n:
            free.add(room - n, window)
    return windows, offsets


def pack(found: DataFrame, n_documents: int, size: int = SEQUENCE, group_documents: int = 2048) -> DataFrame:
    """Adds `sequence_id, offset` to pieces; groups hold about `group_documents` documents each."""
    groups = max(1, -(-n_documents // group_documents))
    dealt = found.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        window, offset = best_fit_decreasing(group["length"].to_numpy(), size)
        first = int(group["_group"][0].as_py()) << 32
        out = group.drop_columns(["_group"])
        return out.append_column("sequence_id", pa.array(first + window)).append_column("offset", pa.array(offset))

    return dealt.groupBy("_group").applyInArrow(one, PIECES + ", sequence_id long, offset long")


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's file as text, read once on the driver; by default the public byte-level BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def pack_documents(documents: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return pack(pieces(documents, tokenizer_json(path), size), documents.count(), size)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` packed into sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
