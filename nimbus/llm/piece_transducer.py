"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into three machines: the normaliser (white space to
the mark U+2581, the dummy prefix, and the removal of extra white space where
the file asks for it), a letter trie of the pieces whose accepting arcs emit a
piece id, and the byte fallback, which emits the byte pieces of any character
that no piece covers. A text is composed with them letter by letter and the
path of least weight in the tropical semiring is taken.

Weights: for unigram files, a piece weighs minus its score, and the bytes of a
fallback character together as much as the unknown piece (10 below the
smallest score). For byte-pair files (merges in the order of scores, not sums
of scores) the states remember the last piece, and an arc from piece a to
piece b weighs 0 where merging the letters of a + b gives back exactly (a, b),
and infinity otherwise. The merges of a text give the one path all of whose
neighbours agree, so each position keeps a single state.

No piece of such a file holds the mark behind another letter, so a text is cut
before marks and each different word is composed once for a worker's bounded
cache, all new words of a slice of texts together: the trie is one table from
(state, letter) to state, and every step takes a letter of all words (numpy).
(Files for which this does not hold are composed whole.)

Defined results for odd input: null and empty texts give no pieces; ids of
rows are carried as they are, nulls too; repeated rows are encoded one by one;
an empty table gives an empty result; other columns are ignored. A text that
holds the mark itself decodes to a space there, as the format has it; all other
texts decode to what they were (up to the normaliser).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nimbus.llm.words import slices

MARK = "▁"
NORMAL, USER_DEFINED, UNUSED, BYTE, UNKNOWN = 1, 4, 5, 6, 2  # piece types of the file format
UNIGRAM, BPE = 1, 2  # model types of the file format
CACHE_LETTERS = 8_000_000  # bounds of the caches; they change no result
CACHE_PAIRS = 500_000
TOGETHER = 64  # letters; longer words are composed one by one


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class ModelFile:
    """What the transducer needs of a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.type, self.byte_fallback = UNIGRAM, False
        self.dummy_prefix, self.remove_extra, self.escape = True, True, True
        for field, value in wire_fields(data):
            if field == 1:
                piece = dict(wire_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif field == 2:
                spec = dict(wire_fields(value))
                self.type, self.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif field == 3:
                spec = dict(wire_fields(value))
                if spec.get(2):
                    raise ValueError("a compiled character map is not supported; give a file with the identity normaliser")
                self.dummy_prefix, self.remove_extra, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))


class Table:
    """Whole numbers by whole numbers (not negative), looked up for many keys at once; open addressing."""

    def __init__(self, room: int = 1 << 12):
        self.bits, self.held = room.bit_length(), 0
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)

    def __len__(self) -> int:
        return self.held

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        out, live, at = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._slots(keys)
        while len(live):
            there = self.keys[at]
            match = there == keys[live]
            out[live[match]] = self.values[at[match]]
            on = ~match & (there >= 0)
            live, at = live[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds different keys that are not in the table."""
        if 2 * (self.held + len(keys)) > len(self.keys):
            old = self.keys >= 0
            grown = Table(2 * (self.held + len(keys)))
            grown.put(self.keys[old], self.values[old])
            self.bits, self.keys, self.values, self.held = grown.bits, grown.keys, grown.values, grown.held
        self.held += len(keys)
        at = self._slots(keys)
        while len(keys):
            # of several keys that want one free slot the first takes it
            place, first = np.unique(at, return_index=True)
            first = first[self.keys[place] < 0]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            on = np.ones(len(keys), bool)
            on[first] = False
            keys, values, at = keys[on], values[on], (at[on] + 1) & ((1 << self.bits) - 1)


class Transducer:
    """The compiled machines; `encode` and `decode`."""

    def __init__(self, data: bytes):
        self.file = file = ModelFile(data)
        self.ids = {p: i for i, (p, _, kind) in enumerate(file.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        self.scores = [score for _, score, _ in file.pieces]
        self.score_of = {p: self.scores[i] for p, i in self.ids.items()}
        self.unknown = next((i for i, (_, _, kind) in enumerate(file.pieces) if kind == UNKNOWN), 0)
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(file.pieces) if kind == BYTE}
        self.text = [bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() if kind in (NORMAL, USER_DEFINED, UNUSED) else b"" for p, _, kind in file.pieces]
        # the trie: a state is a dict from letter to (next state, id or -1)
        self.trie: dict = {}
        for piece, i in self.ids.items():
            state = self.trie
            for letter in piece[:-1]:
                state = state.setdefault(letter, [{}, -1])[0]
            state.setdefault(piece[-1], [{}, -1])[1] = i
        self.whole = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.words: dict[str, bytes] = {}
        self.letters = 0  # in the cached words
        self.pairs = Table()
        self._number_states()
        self.least = min([s for _, s, kind in file.pieces if kind == NORMAL], default=0.0) - 10.0

    def _number_states(self) -> None:
        """The trie as one table of arcs, `state << 21 | letter` to the next state, and the piece that each state accepts."""
        arcs, accepts, todo = [], [-1], [(0, self.trie)]
        for number, state in todo:  # grows while it is read
            for letter, (below, piece) in state.items():
                arcs.append((number << 21 | ord(letter), len(accepts)))
                todo.append((len(accepts), below))
                accepts.append(piece)
        keys, values = np.array(arcs, np.int64).reshape(-1, 2).T
        self.arcs, self.accepts = Table(4 * len(keys) + 1), np.array(accepts, np.int64)
        self.arcs.put(keys, values)

    # normaliser

    def normalise(self, text: str) -> str:
        if self.file.remove_extra:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.file.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.file.escape else text

    # byte fallback

    def fallback(self, letter: str) -> list[int]:
        if self.file.byte_fallback:
            return [self.bytes[b] for b in letter.encode()]
        return [self.unknown]

    # composition and shortest path

    def compose(self, word: str) -> list[int]:
        return self._agreeing(word) if self.file.type == BPE else self._lightest(word)

    def _agreeing(self, word: str) -> list[int]:
        """The path of weight 0: at each place the one piece that agrees with the piece before it."""
        n = len(word)
        last: list[int | None] = [None] * (n + 1)  # the piece that ends here; -1: a fallback letter
        back = [0] * (n + 1)
        for i in range(n):
            before = last[i] if i else -1
            if before is None:
                continue
            state, j, single = self.trie, i, False
            while j < n:
                arc = state.get(word[j])
                if arc is None:
                    break
                state, piece = arc
                j += 1
                single = single or (j == i + 1 and piece >= 0)
                if piece >= 0 and last[j] is None and (before < 0 or self._agree(before, piece)):
                    last[j], back[j] = piece, i
            if not single:  # no piece is this letter alone
                if last[i + 1] is None:
                    last[i + 1], back[i + 1] = -1, i
        path, i = [], n
        while i:
            piece = last[i]
            path.append(self.fallback(word[back[i]]) if piece < 0 else [piece])
            i = back[i]
        return [x for ids in reversed(path) for x in ids]

    def _agree(self, a: int, b: int) -> bool:
        return bool(self._agreements(np.array([a]), np.array([b]))[0])

    def _agreements(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where merging the letters of both pieces gives them back; each pair is merged once for the cache."""
        keys = a << 32 | b
        found = self.pairs.get(keys)
        new = np.unique(keys[found < 0])
        if len(new):
            if len(self.pairs) + len(new) > CACHE_PAIRS:
                self.pairs = Table()
                new = np.unique(keys)
            names = [(self.file.pieces[k >> 32][0], self.file.pieces[k & 0xFFFFFFFF][0]) for k in new.tolist()]
            self.pairs.put(new, np.array([self.keeps(x, y) for x, y in names], np.int32))
            found = self.pairs.get(keys)
        return found > 0

    def compose_many(self, words: list[str]) -> list[bytes]:
        """Ids of many words; those of a byte-pair file are composed together, a letter of all at a time."""
        if self.file.type != BPE:
            return [np.asarray(self.compose(w), "<u4").tobytes() for w in words]
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= TOGETHER]
        for i, w in enumerate(words):
            if len(w) > TOGETHER:
                out[i] = np.asarray(self.compose(w), "<u4").tobytes()
        for i, ids in zip(short, self._agreeing_all([words[i] for i in short]), strict=True):
            out[i] = ids
        return out

    def _agreeing_all(self, words: list[str]) -> list[bytes]:
        """The path of weight 0 of every word, as `_agreeing` finds it for one."""
        if not words:
            return []
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size) - size
        base = start + np.arange(len(words))  # places 0..size of each word
        none, free = -2, -1  # no piece ends here; a fallback letter does
        last, back = np.full(len(letters) + len(words), none, np.int64), np.zeros(len(letters) + len(words), np.int64)
        last[base] = free
        for i in range(int(size.max())):
            here = np.flatnonzero(size > i)
            here = here[last[base[here] + i] != none]
            before, single = last[base[here] + i], np.zeros(len(here), bool)
            at, state, j = np.arange(len(here)), np.zeros(len(here), np.int64), i
            while len(at):
                to = self.arcs.get(state << 21 | letters[start[here[at]] + j]).astype(np.int64)
                at, state, j = at[to >= 0], to[to >= 0], j + 1
                piece, place = self.accepts[state], base[here[at]] + j
                if j == i + 1:
                    single[at] = piece >= 0
                open_ = np.flatnonzero((piece >= 0) & (last[place] == none))
                left, right = before[at[open_]], piece[open_]
                fits = left < 0
                fits[~fits] = self._agreements(left[~fits], right[~fits])
                last[place[open_[fits]]], back[place[open_[fits]]] = right[fits], i
                on = size[here[at]] > j
                at, state = at[on], state[on]
            alone = base[here[~single]] + i + 1  # no piece is this letter alone
            alone = alone[last[alone] == none]
            last[alone], back[alone] = free, i
        # back from the ends of all words, a piece of each at a time
        word, place, steps = np.arange(len(words)), size.copy(), []
        while len(word):
            piece, to = last[base[word] + place], back[base[word] + place]
            steps.append((word, to, piece))
            word, place = word[to > 0], to[to > 0]
        word, place, piece = (np.concatenate(x) for x in zip(*steps, strict=True))
        sort = np.lexsort((place, word))
        word, place, piece = word[sort], place[sort], piece[sort]
        ids = piece.astype("<u4")
        cuts = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        out = [ids[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:], strict=False)]
        for w in np.unique(word[piece < 0]).tolist():  # words with fallback letters
            lo, hi = cuts[w], cuts[w + 1]
            path = [self.fallback(words[w][p]) if x < 0 else [x] for p, x in zip(place[lo:hi].tolist(), piece[lo:hi].tolist(), strict=True)]
            out[w] = np.array([x for ids_ in path for x in ids_], "<u4").tobytes()
        return out

    def keeps(self, left: str, right: str) -> bool:
        """Whether byte-pair merging of left + right ends with these two.

        By its definition: the best-scored neighbours merge first, the leftmost among equals.
        It is over as soon as letters of both sides would merge.
        """
        parts, cut, score = list(left + right), len(left), self.score_of.get
        merged = [score(x + y) for x, y in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, s in enumerate(merged):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return cut == 1 and len(parts) == 2
            if at == cut - 1:
                return False
            cut -= at < cut
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del merged[at]
            if at:
                merged[at - 1] = score(parts[at - 1] + parts[at])
            if at < len(merged):
                merged[at] = score(parts[at] + parts[at + 1])

    def _lightest(self, word: str) -> list[int]:
        """The path of the largest summed score."""
        n = len(word)
        best = [0.0] + [float("-inf")] * n
        arcs: list[tuple[int, list[int]]] = [(0, [])] * (n + 1)
        for i in range(n):
            state, j, single = self.trie, i, False
            while j < n:
                arc = state.get(word[j])
                if arc is None:
                    break
                state, piece = arc
                j += 1
                if piece >= 0:
                    single = single or j == i + 1
                    if best[i] + self.scores[piece] > best[j]:
                        best[j], arcs[j] = best[i] + self.scores[piece], (i, [piece])
            if not single and best[i] + self.least > best[i + 1]:
                best[i + 1], arcs[i + 1] = best[i] + self.least, (i, self.fallback(word[i]))
        path, i = [], n
        while i:
            path.append(arcs[i][1])
            i = arcs[i][0]
        return [x for ids in reversed(path) for x in ids]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of many texts; words that are not in the cache are composed together."""
        given = [self.normalise(t) if t else "" for t in texts]
        if self.whole:
            return self.compose_many(given)
        if self.letters > CACHE_LETTERS:
            self.words, self.letters = {}, 0
        words = self.words
        parts = [self.cut.findall(t) for t in given]
        new = list({w for mine in parts for w in mine if w not in words})
        words.update(zip(new, self.compose_many(new), strict=True))
        self.letters += sum(map(len, new))
        return [b"".join(map(words.__getitem__, mine)) for mine in parts]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.file.dummy_prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=1)
def machine_of(data: bytes) -> Transducer:
    """The compiled file with its caches, kept by a worker from task to task."""
    return Transducer(data)


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read once on the driver; by default the public byte-pair file with byte fallback."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode(documents: DataFrame, model: bytes, keep_ids: bool = True) -> DataFrame:
    """`doc_id, n_pieces, ids_crc32, round_trip` and, with `keep_ids`, `ids array<int>` of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(shared.value)
        for b in (part for batch in batches for part in slices(batch, 1)):
            rows, ids = [], []
            texts = b.column(1).to_pylist()
            for text, out in zip(texts, machine.encode_all(texts), strict=True):
                given = text or ""
                rows.append((len(out) // 4, zlib.crc32(out), machine.decode(out) == machine.normalise(given).replace(MARK, " ")[machine.file.dummy_prefix and given != "" :]))
                if keep_ids:
                    ids.append(np.frombuffer(out, "<u4").astype(np.int32))
            n, crc, same = zip(*rows, strict=True) if rows else ([], [], [])
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            names = ["doc_id", "n_pieces", "ids_crc32", "round_trip"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return documents.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """`doc_id, text` of rows with `doc_id, ids`."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(shared.value)
        for b in batches:
            texts = [machine.decode(np.asarray(x.as_py() or [], "<u4").tobytes()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("CAST(doc_id AS LONG) AS doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op6_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` encoded and decoded: its ids, their number and checksum, and whether it came back."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(documents, model_bytes())
