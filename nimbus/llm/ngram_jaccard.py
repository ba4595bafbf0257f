"""N-gram Jaccard self-join with a count-vector R-tree, and its connected components.

A document is the set of its distinct shingles. The shingles are hashed into a
few groups and the group counts make a point; the overlap of two sets is at
most the sum of the smaller counts. Points are looked up through an R-tree
whose nodes hold the largest counts below them, so a whole node is passed over
when the summed minima can't reach the overlap that the sizes ask for.
Surviving pairs are verified on the whole sets.

Counts of a few groups look alike for any two texts of one length, so a single
tree over all documents would come close to comparing all pairs. The points are
therefore first dealt into cells: two sets with Jaccard t share at least l
shingles among their first n - ceil(t * n) + l in any fixed order of shingles
(here: the ones that many documents hold last, then by hash), so a cell for
each of these shingles loses no pair. A small cell compares its points
directly; a large one pairs all with its middle point, and a second pass
searches it by an R-tree for links between what are still different components.
Equal sets are one node throughout.

Found pairs are first bounded again by finer points (a group for every second
shingle). Then one pair of each node is verified on the whole sets, which ties
a group of near copies together without its square of pairs, and after it the
pairs that are still between different components. Inside a large cell these
are verified where they meet and joined at once, so a cell puts out a forest of
links, never its pairs.

Defined results for odd input: null texts and texts without words have
`n_shingles` 0 and are linked with nothing; texts with fewer words than a
shingle are one shingle; rows without a doc_id have a null component and link
with nothing; repeated rows come back once each, with equal results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbus.llm.components import components
from nimbus.llm.words import LOWER, M2, Words, mix, slices, window_hashes, window_text
from nimbus.session import stored

GROUPS = 16
OVER = np.uint16(65535)  # a count that may be larger
SMALL_CELL = 32
COMMON = 65_536  # shingles that are put last; a matter of speed, any order gives the same pairs
CHUNK = 2048
CHUNK_BYTES = 32 << 20  # of whole sets
BROADCAST_BYTES = 64 << 20


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, shingles): the distinct shingle hashes of text i are shingles[first[i]:first[i + 1]], sorted."""
    words = Words(column, LOWER)
    h, counts = words.hashes(), np.diff(words.first)
    start, text = window_text(words.first, n, len(h))
    found, texts = [window_hashes(h, n, seed=1)[start]] if len(start) else [], [text] if len(start) else []
    for k in range(1, n):  # short texts: the whole sequence as one
        short = np.flatnonzero(counts == k)
        if len(short):
            found.append(window_hashes(h, k, seed=100 + k)[words.first[:-1][short]])
            texts.append(short)
    if not found:
        return np.zeros(len(counts) + 1, np.int64), np.zeros(0, np.uint64)
    s, t = np.concatenate(found), np.concatenate(texts)
    order = np.argsort(s)
    order = order[np.argsort(t[order], kind="stable")]
    s, t = s[order], t[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (t[1:] != t[:-1])]
    s, t = s[new], t[new]
    return np.searchsorted(t, np.arange(len(counts) + 1)), s


def set_keys(first: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """A 63-bit key of every set, from its members and its size."""
    total = np.r_[np.uint64(0), np.cumsum(mix(shingles * M2))]
    sums = total[first[1:]] - total[first[:-1]]
    return (mix(sums + np.diff(first).astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def count_vectors(first: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """(sets, GROUPS) group counts."""
    sets = np.repeat(np.arange(len(first) - 1), np.diff(first))
    group = (mix(shingles) >> np.uint64(32)).astype(np.int64) % GROUPS
    counts = np.bincount(sets * GROUPS + group, minlength=(len(first) - 1) * GROUPS).reshape(-1, GROUPS)
    return np.minimum(counts, OVER).astype(np.uint16)


def fine_points(first: np.ndarray, shingles: np.ndarray) -> list[bytes]:
    """The counts of each set in about half as many groups as it has members, one byte a group (255: or more)."""
    group = (mix(shingles * M2) >> np.uint64(40)).astype(np.int64)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        groups = fine_groups(hi - lo)
        out.append(np.minimum(np.bincount(group[lo:hi] % groups, minlength=groups), 255).astype(np.uint8).tobytes())
    return out


def fine_groups(size: int) -> int:
    """A power of two, so that a finer point folds into a coarser one."""
    return 1 << min(14, max(4, (size // 2).bit_length()))


def fine_bound(a: bytes, b: bytes) -> int:
    """Summed coordinate minima at the coarser of two resolutions."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if (x == 255).any() or (y == 255).any():
        return 1 << 60
    groups = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, groups).sum(axis=0, dtype=np.int64), y.reshape(-1, groups).sum(axis=0, dtype=np.int64)).sum())


class FinePoints:
    """The finer points of a cell, by resolution, for bounds against many of them at once."""

    def __init__(self, points: list[bytes]):
        self.groups = np.array([len(p) for p in points])
        self.place = np.zeros(len(points), np.int64)
        self.tables: dict[int, np.ndarray] = {}
        for g in np.unique(self.groups).tolist():
            at = np.flatnonzero(self.groups == g)
            self.place[at] = np.arange(len(at))
            self.tables[g] = np.stack([np.frombuffer(points[i], np.uint8) for i in at])
        self.over = np.array([b"\xff" in p for p in points])

    def coarse(self) -> np.ndarray:
        """All points folded to GROUPS counts."""
        out = np.zeros((len(self.groups), GROUPS), np.uint16)
        for g, table in self.tables.items():
            out[self.groups == g] = np.minimum(table.reshape(len(table), -1, GROUPS).sum(axis=1, dtype=np.int64), OVER)
        out[self.over] = OVER
        return out

    def bounds(self, q: int, others: np.ndarray) -> np.ndarray:
        """Upper bounds of the overlap of point `q` with each of `others`."""
        most = np.full(len(others), np.int64(1) << 60)
        if self.over[q]:
            return most
        mine = self.tables[int(self.groups[q])][self.place[q]].astype(np.uint32)
        for g in np.unique(self.groups[others]).tolist():
            at = np.flatnonzero((self.groups[others] == g) & ~self.over[others])
            n = min(g, len(mine))
            theirs = self.tables[g][self.place[others[at]]].reshape(len(at), -1, n).sum(axis=1, dtype=np.uint32)
            most[at] = np.minimum(theirs, mine.reshape(-1, n).sum(axis=0, dtype=np.uint32)).sum(axis=1, dtype=np.int64)
        return most


class Threshold:
    """Links where 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent

    def links(self, both, a, b):
        return 100 * both >= self.percent * (a + b - both)

    def overlap(self, a, b):
        """The least intersection of linked sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def sizes(self, a, b):
        return (100 * a >= self.percent * b) & (100 * b >= self.percent * a)

    def least_shared(self, n):
        """l: how many shingles of their prefixes linked sets share, for the smaller of their sizes."""
        return 1 + n // 32

    def prefix(self, n):
        return np.minimum(n, n - -(-self.percent * n // 100) + self.least_shared(n))


def minima(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap: summed coordinate minima (a count at OVER has no bound)."""
    low = np.minimum(a, b).astype(np.int64)
    return np.where((low == OVER).any(axis=-1), np.int64(1) << 60, low.sum(axis=-1))


class CountRTree:
    """A packed R-tree over count vectors, ordered by set size and then by the first coordinates.

    Each level holds the largest counts, the sizes and the labels of `fan` nodes below it.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, labels: np.ndarray, fan: int = 16):
        self.fan = fan
        self.order = np.lexsort((vectors[:, 0], sizes, labels))
        level = {"high": vectors[self.order], "least": sizes[self.order], "most": sizes[self.order], "low_label": labels[self.order], "high_label": labels[self.order]}
        self.levels = [level]
        while len(level["least"]) > fan:
            at = np.arange(0, len(level["least"]), fan)
            level = {
                "high": np.maximum.reduceat(level["high"], at), "least": np.minimum.reduceat(level["least"], at), "most": np.maximum.reduceat(level["most"], at),
                "low_label": np.minimum.reduceat(level["low_label"], at), "high_label": np.maximum.reduceat(level["high_label"], at),
            }
            self.levels.append(level)

    def search(self, vector: np.ndarray, size: int, label: int, by: Threshold) -> np.ndarray:
        """Points of another label that may link with this one."""
        at = np.arange(len(self.levels[-1]["least"]))
        for depth in range(len(self.levels) - 1, -1, -1):
            x = self.levels[depth]
            keep = (100 * size >= by.percent * x["least"][at]) & (100 * x["most"][at] >= by.percent * size)
            keep &= (x["low_label"][at] != label) | (x["high_label"][at] != label)
            at = at[keep]
            at = at[minima(vector[None, :], x["high"][at]) >= by.overlap(size, x["least"][at])]
            if depth:
                at = (at[:, None] * self.fan + np.arange(self.fan)).reshape(-1)
                at = at[at < len(self.levels[depth - 1]["least"])]
        return self.order[at]


FOUND = "kind int, a long, b long, shared long, need long"


def _found(kind: int, a, b=None, shared=None, need=None) -> pa.RecordBatch:
    n = len(a)
    none = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(np.asarray(x, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), none(a), none(b), none(shared), none(need)], ["kind", "a", "b", "shared", "need"])


def _cells(table: pa.Table, by: Threshold) -> pa.Table:
    """All cells of one bucket. Kind 0: pairs of small cells with the number of cells that they share;
    kind 1: pairs with the middle point of a large cell; kind 2: the points of large cells."""
    rows = table.to_pylist()
    keys = np.concatenate([np.frombuffer(r["keys"], np.int64) for r in rows])
    sizes = np.concatenate([np.frombuffer(r["sizes"], np.int32) for r in rows]).astype(np.int64)
    counts = np.concatenate([np.frombuffer(r["counts"], np.uint16).reshape(-1, GROUPS) for r in rows])
    base = np.cumsum([0] + [len(r["keys"]) // 8 for r in rows])
    cell = np.concatenate([np.frombuffer(r["cells"], np.uint64) for r in rows])
    node = np.concatenate([np.frombuffer(r["nodes"], np.uint32).astype(np.int64) + b for r, b in zip(rows, base, strict=False)])
    # equal sets of several slices become one node
    _, at, same = np.unique(keys, return_index=True, return_inverse=True)
    keys, sizes, counts, node = keys[at], sizes[at], counts[at], same[node]
    order = np.lexsort((node, cell))
    cell, node = cell[order], node[order]
    new = np.r_[True, (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])]
    cell, node = cell[new], node[new]
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    held = np.diff(np.r_[first, len(cell)])
    out = [_found(0, [])]
    # small cells: members are paired by their distance in the cell, for all cells at once
    pairs = []
    for step in range(1, min(SMALL_CELL, int(held.max(initial=1)))):
        cells = np.flatnonzero((held > step) & (held <= SMALL_CELL))
        if not len(cells):
            break
        reach = held[cells] - step
        lo = np.repeat(first[cells], reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        a, b = node[lo], node[lo + step]
        ok = by.sizes(sizes[a], sizes[b])
        pairs.append(a[ok] * len(keys) + b[ok])
    if pairs:
        both, shared = np.unique(np.concatenate(pairs), return_counts=True)
        a, b = both // len(keys), both % len(keys)
        ok = minima(counts[a], counts[b]) >= by.overlap(sizes[a], sizes[b])
        a, b, shared = a[ok], b[ok], shared[ok]
        out.append(_found(0, keys[a], keys[b], shared, by.least_shared(np.minimum(sizes[a], sizes[b]))))
    stars = []
    for c in np.flatnonzero(held > SMALL_CELL):
        members = node[first[c] : first[c] + held[c]]
        members = members[np.argsort(sizes[members], kind="stable")]
        middle, rest = members[len(members) // 2], np.delete(members, len(members) // 2)
        ok = by.sizes(sizes[middle], sizes[rest]) & (minima(counts[middle][None, :], counts[rest]) >= by.overlap(sizes[middle], sizes[rest]))
        stars.append(middle * len(keys) + rest[ok])
        cell_id = np.uint64(cell[first[c]]).astype(np.int64)
        out.append(_found(2, keys[members], np.full(len(members), cell_id)))
    if stars:
        both = np.unique(np.concatenate(stars))
        out.append(_found(1, keys[both // len(keys)], keys[both % len(keys)]))
    return pa.Table.from_batches(out)


def _described(documents: DataFrame, n: int) -> DataFrame:
    """Kind 0: `id, key, size, point` of every row; kind 1: shingles that several sets of a slice share, with their number."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "key", "size", "point"]
        for batch in batches:
            for b in slices(batch, 1):
                first, shingles = shingle_sets(b.column(1), n)
                keys, sizes = set_keys(first, shingles), np.diff(first)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int32)), b.column(0), pa.array(keys), pa.array(sizes), pa.array(fine_points(first, shingles), pa.binary())], names)
                _, once = np.unique(keys, return_index=True)
                mine = np.concatenate([shingles[first[i] : first[i + 1]] for i in once]) if len(once) else shingles[:0]
                value, held = np.unique(mine, return_counts=True)
                value, held = value[held >= 2].astype(np.int64), held[held >= 2]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(value), np.int32)), pa.nulls(len(value), pa.int64()), pa.array(value), pa.array(held), pa.nulls(len(value), pa.binary())], names)

    return documents.mapInArrow(describe, "kind int, id long, key long, size long, point binary")


def _postings(documents: DataFrame, n: int, by: Threshold, common: np.ndarray, buckets: int) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(common)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in batches:
            for b in slices(batch, 1):
                first, shingles = shingle_sets(b.column(1), n)
                keys, sizes = set_keys(first, shingles), np.diff(first)
                _, once = np.unique(keys, return_index=True)
                once = np.sort(once[(sizes[once] > 0)])
                once = once[b.column(0).is_valid().to_numpy(zero_copy_only=False)[once]]
                if not len(once):
                    continue
                counts = count_vectors(first, shingles)
                # the prefix: rare shingles first, each kind by hash (the sets are sorted by it)
                late = last[np.searchsorted(last, shingles).clip(max=len(last) - 1)] == shingles if len(last) else np.zeros(len(shingles), bool)
                sets = np.repeat(np.arange(len(sizes)), sizes)
                order = np.argsort(sets * 2 + late, kind="stable")
                rank = np.arange(len(shingles)) - first[:-1][sets]
                chosen = np.zeros(len(sizes), bool)
                chosen[once] = True
                take = order[(rank < by.prefix(sizes)[sets]) & chosen[sets]]
                place = np.cumsum(chosen) - 1
                node, cell = place[sets[take]], shingles[take]
                bucket = (mix(cell) >> np.uint64(33)).astype(np.int64) % buckets
                sort = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[sort], np.arange(buckets + 1))
                rows = []
                for i in range(buckets):
                    at = sort[cuts[i] : cuts[i + 1]]
                    if len(at):
                        used, to = np.unique(node[at], return_inverse=True)
                        of = once[used]
                        rows.append((i, keys[of].tobytes(), sizes[of].astype(np.int32).tobytes(), counts[of].tobytes(), cell[at].tobytes(), to.astype(np.uint32).tobytes()))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["bucket", "keys", "sizes", "counts", "cells", "nodes"])

    return documents.mapInArrow(post, "bucket int, keys binary, sizes binary, counts binary, cells binary, nodes binary")


def _bounded(pairs: DataFrame, points: DataFrame, by: Threshold) -> DataFrame:
    """The pairs whose finer points allow a link. `points`: `key, size, point`, one row each."""
    one, two = points.toDF("a", "size_a", "point_a"), points.toDF("b", "size_b", "point_b")
    full = pairs.join(one, "a").join(two, "b").select("a", "b", "size_a", "size_b", "point_a", "point_b")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            need = by.overlap(b.column(2).to_numpy(), b.column(3).to_numpy())
            most = [fine_bound(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(np.array(most, np.int64) >= need, pa.bool_()))

    return full.mapInArrow(bound, "a long, b long")


def _members(nodes: DataFrame, rows: DataFrame, documents: DataFrame, n: int) -> DataFrame:
    """`key, members`: the whole shingle sets of `nodes` (`key`)."""
    asked = stored(rows.join(nodes, "key").groupBy("key").agg(F.min("id").alias("doc_id")), "asked")
    if asked.count() * 32 <= BROADCAST_BYTES:  # else the texts are shuffled
        asked = F.broadcast(asked)
    texts = documents.join(asked, "doc_id").select("key", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1):
                first, shingles = shingle_sets(b.column(1), n)
                mine = set_keys(first, shingles) == b.column(0).to_numpy()  # not another text of the same id
                data = [shingles[lo:hi].tobytes() for lo, hi in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["key", "members"]).filter(pa.array(mine))

    return texts.mapInArrow(sets, "key long, members binary").dropDuplicates(["key"])


def shared(p: np.ndarray, q: np.ndarray) -> int:
    """Size of the intersection of two sets without repeats."""
    both = np.concatenate([p, q])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _verified(pairs: DataFrame, rows: DataFrame, documents: DataFrame, n: int, by: Threshold) -> DataFrame:
    """`a, b` of the pairs whose whole sets link."""
    nodes = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    members = _members(nodes, rows, documents, n)
    one, two = members.toDF("a", "members_a"), members.toDF("b", "members_b")
    full = pairs.join(one, "a").join(two, "b").select("a", "b", "members_a", "members_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(bool(by.links(shared(p, q), len(p), len(q))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.mapInArrow(verify, "a long, b long")


def earlier_cells(cells: pa.ListArray, cell: int) -> np.ndarray:
    """For each member one bit for each cell before `cell` that several members share, packed."""
    if isinstance(cells, pa.ChunkedArray):
        cells = cells.chunk(0)
    member = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy())
    ids = cells.flatten().to_numpy()
    member, ids = member[ids < cell], ids[ids < cell]
    names, column, held = np.unique(ids, return_inverse=True, return_counts=True)
    several = held > 1
    place = np.cumsum(several) - 1
    keep = several[column]
    bits = np.zeros((len(cells), max(1, int(several.sum()))), bool)
    bits[member[keep], place[column[keep]]] = True
    return np.packbits(bits, axis=1)


class Cell:
    """The members of a chunk pair of one large cell, and the pairs among them that may link."""

    def __init__(self, table: pa.Table, by: Threshold):
        self.by, self.cell = by, table["b"][0].as_py()
        self.keys, self.size, self.given, mine = (table[c].to_numpy() for c in ("a", "size", "label", "mine"))
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        self.here, self.there, self.one = np.flatnonzero(mine == i), np.flatnonzero(mine == j), i == j
        self.fine = FinePoints(table["point"].to_pylist())
        self.earlier = earlier_cells(table["cells"].combine_chunks(), self.cell)
        self.vectors = self.fine.coarse()

    def pairs(self, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(member, its possible partners of other labels, the most promising first); a pair is met once, in its first cell."""
        if not len(self.there):
            return
        keys, size = self.keys, self.size
        tree = CountRTree(self.vectors[self.there], size[self.there], self.given[self.there])
        for q in self.here:
            hit = self.there[tree.search(self.vectors[q], int(size[q]), int(self.given[q]), self.by)]
            hit = hit[(label[hit] != label[q]) & (keys[hit] > keys[q] if self.one else keys[hit] != keys[q])]
            hit = hit[~(self.earlier[hit] & self.earlier[q]).any(axis=1)]
            spare = self.fine.bounds(q, hit) - self.by.overlap(size[q], size[hit])
            hit = hit[spare >= 0][np.argsort(-spare[spare >= 0], kind="stable")]
            if len(hit):
                yield q, hit


def _across(cells: DataFrame, points: DataFrame, labels: DataFrame, rows: DataFrame, documents: DataFrame, n: int, by: Threshold) -> DataFrame:
    """Links of large cells between different components: an R-tree for each chunk of a cell.

    `cells`: `a` a member, `b` its cell. A first pass over the points marks the members that some other may link with;
    only their whole sets go to their cells. There the pairs that the finer points allow are verified, the most
    promising first, and a link joins both components at once, so that pairs inside are passed over. What comes out is
    a forest: less than a link for each member of a chunk pair, however alike the members are.
    """
    labelled = cells.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("component", "a"))
    mixed = labelled.groupBy("b").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("b")
    # all large cells of a member (no more than its prefix): a pair is met in the first cell that both are in
    of = cells.groupBy("a").agg(F.collect_list("b").alias("cells"))
    described = labelled.join(mixed, "b").join(points.withColumnRenamed("key", "a"), "a").join(of, "a")
    members = stored(described.select("a", "b", "size", "point", "cells", "label"), "mixed")

    def met(members: DataFrame, weight: int) -> DataFrame:
        """Members once for each chunk pair `i, j` of their cell; a chunk has a bounded number of rows, and of bytes at `weight` a shingle."""
        chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("size") * weight / CHUNK_BYTES)).cast("int").alias("chunks")
        mine = F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int")
        dealt = members.join(members.groupBy("b").agg(chunks), "b").withColumn("mine", mine)
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        return dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("chunks", "other")

    def promising(table: pa.Table) -> pa.Table:
        cell = Cell(table, by)
        marked = np.zeros(len(cell.keys), bool)
        for q, hit in cell.pairs(cell.given):
            marked[q] = marked[hit] = True
        return pa.table({"a": cell.keys[marked], "b": np.full(int(marked.sum()), cell.cell)})

    marked = stored(met(members, 1).groupBy("b", "i", "j").applyInArrow(promising, "a long, b long").distinct(), "promising")
    sets = _members(marked.select(F.col("a").alias("key")).distinct(), rows, documents, n).withColumnRenamed("key", "a")
    whole = stored(members.join(marked, ["a", "b"]).join(sets, "a"), "promising-sets")

    def search(table: pa.Table) -> pa.Table:
        cell = Cell(table, by)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["members"]]
        label, a, b = cell.given.copy(), [], []
        for q, hit in cell.pairs(label):
            for h in hit:
                if label[h] != label[q] and by.links(shared(sets[q], sets[h]), len(sets[q]), len(sets[h])):
                    a.append(cell.keys[q])
                    b.append(cell.keys[h])
                    label[label == label[h]] = label[q]
        return pa.table({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return met(whole, 8).groupBy("b", "i", "j").applyInArrow(search, "a long, b long")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs between different components."""
    for c in ("a", "b"):
        of = labels.toDF(c, f"label_{c}")
        pairs = pairs.join(of, c, "left").withColumn(f"label_{c}", F.coalesce(f"label_{c}", c))
    return pairs.where("label_a <> label_b").select("a", "b")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: the components that are there are the nodes now."""
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    every = labels.unionByName(nodes.join(labels, "node", "left_anti").select("node", F.col("node").alias("component")))
    ends = links
    for c in ("a", "b"):
        ends = ends.join(every.toDF(c, f"label_{c}"), c)
    merged = components(ends.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct())
    merged = merged.toDF("component", "whole")
    return every.join(merged, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))


def self_join(documents: DataFrame, n: int = 4, percent: int = 85, bucket_bytes: int = 64 << 20) -> DataFrame:
    """`doc_id, n_shingles, component_id` of every row."""
    by, spark = Threshold(percent), documents.sparkSession
    lean = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = lean.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    buckets = max(16, -(-size // bucket_bytes))
    described = stored(_described(lean, n), "sets")
    rows = described.where("kind = 0").select("id", "key", F.col("size").alias("n"))
    linkable = rows.where("n > 0 AND id IS NOT NULL")
    top = described.where("kind = 1").groupBy("key").agg(F.sum("size").alias("n")).where("n >= 16").orderBy(F.desc("n"), "key").limit(COMMON)
    common = np.sort(np.array([r["key"] for r in top.select("key").collect()], np.int64).astype(np.uint64))  # at most COMMON
    postings = _postings(lean, n, by, common, buckets)
    found = stored(postings.groupBy("bucket").applyInArrow(lambda t: _cells(t, by), FOUND), "cells")
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    counted = found.where("kind = 0").select(*ordered, "shared", "need").groupBy("a", "b")
    near = counted.agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).where("shared >= need").select("a", "b")
    near = near.unionByName(found.where("kind = 1").select(*ordered)).distinct()
    points = described.where("kind = 0 AND size > 0 AND id IS NOT NULL").groupBy("key").agg(F.first("size").alias("size"), F.first("point").alias("point"))
    near = stored(_bounded(near, points, by), "near")
    # one pair of each node from either side: this keeps every star whole
    one = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    one = one.unionByName(near.groupBy("a").agg(F.min("b").alias("b"))).distinct()
    links = stored(_verified(one, linkable, lean, n, by), "links")
    # labels are written after every step: their plans would else grow into each other
    labels = stored(components(links), "labels")
    across = _across(found.where("kind = 2").select("a", "b").distinct(), points, labels, linkable, lean, n, by)
    apart = stored(_apart(near, labels), "apart")
    more = stored(_verified(apart, linkable, lean, n, by).unionByName(across), "links")
    if more.limit(1).count():
        labels = stored(_joined(labels, more), "labels")
    # one row for each distinct set from here on: copies are folded before the shuffle, not joined one by one
    sets = linkable.groupBy("key").agg(F.min("id").alias("id"))
    of = sets.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    first = of.groupBy("component").agg(F.min("id").alias("component_id"))
    named = stored(of.join(first, "component").select("key", "component_id"), "named")
    # a join of its own, so that the rows of a hot key can be dealt to several tasks
    out = rows.join(named, "key", "left")
    own = F.when(F.col("id").isNull(), F.lit(None).cast("long")).when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of `documents` linked at Jaccard 0.85 of their 4-word shingles."""
    return self_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), placed AS (
  SELECT row_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words
), windows AS (
  SELECT row_id, n, pos, list(word) OVER (PARTITION BY row_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS win FROM placed
), shingles AS (
  SELECT DISTINCT row_id, win FROM windows WHERE len(win) = 4 OR (n < 4 AND pos = 1)
), sizes AS (
  SELECT row_id, count(*) AS n FROM shingles GROUP BY row_id
), met AS (
  SELECT a.row_id AS a, b.row_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.win = b.win AND a.row_id < b.row_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM met JOIN sizes x ON x.row_id = a JOIN sizes y ON y.row_id = b WHERE 100 * met.n >= 85 * (x.n + y.n - met.n)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(a, b) AS (
  SELECT row_id, row_id FROM words UNION SELECT r.a, e.b FROM reached r JOIN edges e ON e.a = r.b
)
SELECT w.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, CASE WHEN w.doc_id IS NOT NULL THEN min(o.doc_id) END AS component_id
FROM words w JOIN reached r ON r.a = w.row_id JOIN words o ON o.row_id = r.b LEFT JOIN sizes s ON s.row_id = w.row_id
GROUP BY w.row_id, w.doc_id
"""
