"""Packing, substring dedup, n-gram join, language models, pieces and toxicity on odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nimbus import session
from nimbus.llm import components, cross_entropy, ngram_jaccard, packing, piece_transducer, substring_dedup, toxicity
from nimbus.llm.words import Words, window_hashes, window_text
from tests.llm.conftest import ROWS, frame

WS = b" \t\n\x0b\x0c\r"


def words_of(text):
    return (text or "").encode().split()


# ------------------------------------------------------------------ words


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\u00a0é漢", max_size=40)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words_and_hashes(texts):
    w = Words(pa.array(["junk", *texts], pa.string()).slice(1))
    expected = [words_of(t) for t in texts]
    got = [[bytes(w.raw[w.start[i] : w.end[i]]) for i in range(w.first[k], w.first[k + 1])] for k in range(len(texts))]
    assert got == expected
    seen = {}
    for h, word in zip(w.hashes().tolist(), [x for e in expected for x in e], strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    start, text = window_text(w.first, 3, len(w))
    assert Counter(text.tolist()) == Counter({k: len(e) - 2 for k, e in enumerate(expected) if len(e) > 2})
    assert len(window_hashes(w.hashes(), 3)) == max(0, len(w) - 2)


# ---------------------------------------------------------------- packing


@given(st.text(alphabet="ab c's'll 12\t\n é—漢½\x85\u00a0<|>", max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_gives_the_ids_of_the_tokenizer(text):
    assert ENCODER.encode(text) == np.asarray(ENCODER.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


ENCODER = packing.Encoder(packing.tokenizer_json())


def test_special_text_is_encoded_like_the_tokenizer():
    for text in ("a<|endoftext|>b", "  lead", "x\u200by", "it's we'll"):
        assert ENCODER.encode(text) == np.asarray(ENCODER.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def check_pieces(rows, texts, size):
    held = {}
    for r in rows:
        assert 0 < r.length <= size and r.offset >= 0 and r.offset + r.length <= size
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in held.values():  # gapless from 0
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
    expected = Counter()
    for i, t in texts:
        ids = np.asarray([*ENCODER.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), size):
            part = ids[s : s + size]
            expected[(i, s, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == expected


def test_packing_of_odd_rows(odd, none):
    check_pieces(packing.pack_documents(odd, size=256).collect(), ROWS, 256)
    assert packing.pack_documents(none).count() == 0


def test_best_fit_is_the_tightest_window():
    rng = random.Random(3)
    lengths = np.array([rng.randint(1, 100) for _ in range(400)])
    windows, offsets = packing.best_fit_decreasing(lengths, 100)
    room, at = {}, {}
    for i in np.argsort(-lengths, kind="stable"):
        n, w = int(lengths[i]), int(windows[i])
        fits = [r for r in room.values() if r >= n]
        if w not in room:
            assert not fits and offsets[i] == 0
            room[w], at[w] = 100, 0
        else:
            assert room[w] == min(fits)
        assert offsets[i] == at[w]
        room[w] -= n
        at[w] += n


# --------------------------------------------------------- substring dedup


def brute_dedup(rows, k=13):
    first = {}
    for i, t in rows:
        w = words_of(t)
        if i is not None:
            for j in range(len(w) - k + 1):
                key = tuple(w[j : j + k])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        if i is not None:
            for j in range(len(w) - k + 1):
                if first[tuple(w[j : j + k])] < i:
                    gone[j : j + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [1 << 23, 2000])
def test_substring_dedup_of_odd_rows(spark, odd, none, block_bytes):
    rng = random.Random(5)
    letters = "abc"
    rows = ROWS + [(100 + i, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    for k in (13, 4):
        got = substring_dedup.digest(frame(spark, rows).repartition(4), k, block_bytes).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_dedup(rows, k)
    assert substring_dedup.digest(none).count() == 0
    clean = substring_dedup.dedup(odd, block_bytes=block_bytes)
    assert clean.schema.simpleString() == odd.schema.simpleString()
    texts = Counter((r.doc_id, r.text, r.n_chars) for r in clean.collect())
    assert texts[(3, "", 0)] == 0 and texts[(3, "tonight", 7)] == 1  # its first 18 words are in document 1
    assert texts[(1, ROWS[0][1], len(ROWS[0][1]))] == 1 and texts[(None, ROWS[0][1], len(ROWS[0][1]))] == 1
    assert texts[(4, None, None)] == 1 and texts[(6, " \t\n ", 4)] == 1 and texts[(8, "one two", 7)] == 2
    assert texts[(11, "end", 3)] == 1


# --------------------------------------------------------------- n-gram join


def brute_components(rows, percent=85, n=4):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
        sets.setdefault((i, s), None)
    nodes = [(i, s) for i, s in sets if i is not None and s]
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if root(a) != root(b) and 100 * len(a[1] & b[1]) >= percent * len(a[1] | b[1]):
                parent[root(a)] = root(b)
    least = {}
    for x in nodes:
        least[root(x)] = min(x[0], least.get(root(x), x[0]))
    out = Counter()
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
        out[(i, len(s), None if i is None else least[root((i, s))] if s else i)] += 1
    return out


def near_copies(seed, groups, members, length):
    rng = random.Random(seed)
    rows, i = [], 1000
    for g in range(groups):
        base = [f"g{g}w{rng.randint(0, 10**6)}" for _ in range(length)]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10**6)}"
            rows.append((i, " ".join(w)))
            i += 1
    return rows


@pytest.mark.parametrize("small", [32, 2])
def test_ngram_components(spark, odd, none, small, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "SMALL_CELL", small)  # 2: nearly all cells go through the tree
    rows = ROWS + near_copies(1, 4, 25, 60) + near_copies(2, 1, 60, 90)
    got = ngram_jaccard.self_join(frame(spark, rows).repartition(4)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    if small == 32:
        assert ngram_jaccard.self_join(none).count() == 0


def test_component_rounds_end_with_stars(spark, monkeypatch):
    """Edges that are stars already need no round, and no second look at the result of the last one."""
    written, released, real = [], [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, label, *a: written.append(label) or real(df, label, *a))
    monkeypatch.setattr(session, "release_driver", lambda s: released.append(s))
    stars = [(1, 2), (5, 1), (3, 1), (7, 8), (8, 8), (2, 1)]
    found = components.components(spark.createDataFrame(stars, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1), (5, 1), (7, 7), (8, 7)]
    assert written == ["links"] and len(released) == 1
    assert not components.components(spark.createDataFrame([], "a long, b long")).collect()
    written.clear()
    random.seed(4)
    ids = random.sample(range(1000), 40)
    chain = list(zip(ids, ids[1:], strict=False))
    found = components.components(spark.createDataFrame(chain, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == sorted((i, min(ids)) for i in ids)
    u, v = components.F.greatest("a", "b").alias("u"), components.F.least("a", "b").alias("v")
    assert not components._stars(spark.createDataFrame(chain, "a long, b long").select(u, v))
    assert not components._stars(spark.createDataFrame([(3, 2), (2, 1)], "u long, v long"))
    assert not components._stars(spark.createDataFrame([(3, 2), (3, 1)], "u long, v long"))


def test_tree_keeps_every_pair_that_the_minima_allow():
    rng = np.random.default_rng(0)
    vectors = rng.poisson(6, size=(300, ngram_jaccard.GROUPS)).astype(np.uint16)
    sizes, labels = vectors.sum(axis=1).astype(np.int64), rng.integers(0, 9, 300)
    by = ngram_jaccard.Threshold(70)
    tree = ngram_jaccard.CountRTree(vectors, sizes, labels)
    for q in range(0, 300, 7):
        allowed = by.sizes(sizes[q], sizes) & (ngram_jaccard.minima(vectors[q][None], vectors) >= by.overlap(sizes[q], sizes)) & (labels != labels[q])
        assert set(np.flatnonzero(allowed)) <= set(tree.search(vectors[q], int(sizes[q]), int(labels[q]), by))


# ------------------------------------------------------------ cross entropy


def test_cross_entropy_against_counting(spark, odd, none):
    targets = spark.createDataFrame([(1,), (3,), (None,), (8,), (8,), (999,)], "doc_id long")
    for size in (65_534, 5):
        got = cross_entropy.score(odd, targets, vocabulary=size).collect()
        n, nt, pairs, first = Counter(), Counter(), [Counter(), Counter()], [0, 0]
        marked = [(words_of(t), i in (1, 3, 8)) for i, t in ROWS]
        for w, hit in marked:
            n.update(w)
            if hit:
                nt.update(w)
        known = {w for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:size]}
        single = [Counter(), Counter()]
        for w, hit in marked:
            s = [None, *[x if x in known else b"?" for x in w]]
            for m in (0, 1) if hit else (0,):
                first[m] += bool(w)
                single[m].update(s[1:])
                pairs[m].update(zip(s, s[1:], strict=False))
        expected = Counter()
        for (w, _), (i, _) in zip(marked, ROWS, strict=True):
            s, loss = [None, *[x if x in known else b"?" for x in w]], [0.0, 0.0]
            for u, v in zip(s, s[1:], strict=False):
                for m in (0, 1):
                    before = max(1, first[m] if u is None else single[m][u])
                    loss[m] -= math.log(0.75 * pairs[m][u, v] / before + 0.25 * (single[m][v] + 1) / ([n, nt][m].total() + len(known) + 1))
            loss = [x / max(1, len(w)) for x in loss]
            expected[(i, len(w), *[round(x, 9) for x in (*loss, loss[1] - loss[0])])] += 1
        zero = lambda x: 0.0 if abs(x) < 1e-9 else round(x, 9)
        assert Counter((r.doc_id, r.n_words, zero(r.background_loss), zero(r.target_loss), zero(r.score)) for r in got) == expected
    assert cross_entropy.score(none, targets).count() == 0


def test_cross_entropy_knows_every_word(spark):
    rng = random.Random(4)
    texts = [[f"w{i}" for i in range(70_000)]] + [[f"w{rng.randrange(69_900, 70_000)}" for _ in range(50)] for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    hit = {3, 4, 5}
    models = []
    for used in (range(len(texts)), hit):
        single = Counter(w for i in used for w in texts[i])
        models.append((single, Counter(p for i in used for p in zip([None, *texts[i]], texts[i], strict=False)), len(used)))
    targets = spark.createDataFrame([(i,) for i in hit], "doc_id long")
    for size in ({}, {"vocabulary": 70_000}):
        got = cross_entropy.score(frame(spark, rows).repartition(3), targets, **size).collect()
        assert len(got) == len(rows)
        for r in got:
            loss = []
            for single, pairs, first in models:
                total = single.total()
                p = [0.75 * pairs[u, w] / max(1, first if u is None else single[u]) + 0.25 * (single[w] + 1) / (total + 70_001) for u, w in zip([None, *texts[r.doc_id]], texts[r.doc_id], strict=False)]
                loss.append(-sum(map(math.log, p)) / len(p))
            assert (r.background_loss, r.target_loss) == pytest.approx(tuple(loss), abs=1e-9)


def test_a_common_bigram_is_one_number_a_slice():
    for texts in (3, 3000):
        batch = pa.record_batch([pa.array(range(texts)), pa.array(["the same"] * texts), pa.array([i % 3 == 0 for i in range(texts)])], ["doc_id", "text", "target"])
        rows = cross_entropy._sliced(batch, None, 0, 16).to_pylist()
        n, n_target = (sorted(x for r in rows for x in cross_entropy.unpack(r[c]).tolist()) for c in ("n", "n_target"))
        # two words, the start, and a bigram for each word
        assert n == [texts] * 5 and n_target == [texts // 3] * 5


# ------------------------------------------------------------------- pieces

PIECES = piece_transducer.Transducer(piece_transducer.model_bytes())


@given(st.text(alphabet="abe thing\t\n  é漢😀ﬁ①<>0x", max_size=50))
@settings(max_examples=300, deadline=None)
def test_pieces_equal_the_library(text):
    sentencepiece = pytest.importorskip("sentencepiece")
    import public_tokenizers

    global LIBRARY
    if "LIBRARY" not in globals():
        LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = PIECES.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text)
    assert PIECES.decode(ids) == text


def test_piece_table(spark, odd, none):
    model = piece_transducer.model_bytes()
    found = piece_transducer.encode(odd, model)
    assert all(r.round_trip for r in found.collect())
    back = piece_transducer.decode(found, model)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t in ROWS)
    assert piece_transducer.encode(none, model).count() == 0


def test_lightest_path_of_a_unigram_file():
    def message(field, value):
        return bytes([field << 3 | 2, len(value)]) + value

    import struct

    def piece(text, score, kind=1):
        return message(1, message(1, text.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))

    data = piece("<unk>", 0, 2) + piece("a", -2) + piece("b", -2) + piece("ab", -3) + piece("aba", -3.5) + piece("▁", -1)
    machine = piece_transducer.Transducer(data + message(2, bytes([3 << 3, 1])) + message(3, bytes([3 << 3, 0, 4 << 3, 0])))
    ids = np.frombuffer(machine.encode("ababa"), "<u4").tolist()
    assert sum(machine.scores[i] for i in ids) == -6.5 and "".join(machine.file.pieces[i][0] for i in ids) == "ababa"
    assert np.frombuffer(machine.encode("azb"), "<u4").tolist() == [1, 0, 2]


def test_a_group_of_many_near_copies_puts_out_a_forest(spark, monkeypatch):
    """2,000 near copies, most of them no link of the middle one: less links come out of a cell than it has members."""
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(2000):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(40)] = f"edit{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    seen = []
    across = ngram_jaccard._across

    def counted(cells, *rest):
        out = ngram_jaccard._scratch(across(cells, *rest), "forest")
        seen.append((cells.count(), out.count()))
        return out

    monkeypatch.setattr(ngram_jaccard, "_across", counted)
    monkeypatch.setattr(ngram_jaccard, "CHUNK", 500)
    got = ngram_jaccard.self_join(frame(spark, rows).repartition(4)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    members, links = seen[0]
    assert members > 2000 and links < 2000 * 4  # below the members of the chunk pairs, not the 2 million pairs


# ----------------------------------------------------------------- toxicity


def test_the_step_follows_the_gradient_of_the_corrected_risk():
    """One step of size `rate` goes against the sign of the numeric gradient of the non-negative risk."""
    rng = random.Random(3)
    pos = [np.array(sorted({0, 1, rng.randint(2, 9)})) for _ in range(40)]
    unl = [np.array(sorted({rng.randint(0, 19), rng.randint(5, 19)})) for _ in range(120)]
    prior, bits = 0.2, 5
    kept = toxicity.select(pos, unl, 1 << bits, prior)
    assert len(kept)

    def risk(w, b):
        z = lambda docs: np.array([sum(w[f] for f in d) + b for d in docs])
        loss = lambda v: np.logaddexp(0, v).mean()
        negative = loss(z(unl)) - prior * loss(z(pos))
        assert negative >= 0  # the branch of the plain risk
        return prior * loss(-z(pos)) + negative

    w, b = np.zeros(1 << bits), float(np.log(prior / (1 - prior)))
    one = toxicity.fit(pos, unl, prior, bits, rounds=1, rate=1e-3, decay=0.0)
    for f in kept:
        up, down = w.copy(), w.copy()
        up[f] += 1e-5
        down[f] -= 1e-5
        slope = (risk(up, b) - risk(down, b)) / 2e-5
        assert one.weights[f] == pytest.approx(-1e-3 * np.sign(slope), rel=1e-3) or abs(slope) < 1e-6


def test_a_column_of_the_score_s_name(spark, odd):
    from pyspark.sql import functions as F

    import corpus_pipeline

    model = toxicity.Classifier(0.0, np.zeros(1 << toxicity.BITS))
    clash = odd.withColumn("_score", F.lit("mine")).withColumn("__SCORE", F.lit(1))
    name = toxicity.free_name(clash.columns)
    assert name == "___score" and toxicity.score(clash, model, name).where(F.col(name) == 0.5).count() == odd.count()
    with pytest.raises(ValueError, match="of their own"):
        toxicity.score(clash, model)
    assert corpus_pipeline.toxicity.free_name(odd.columns) == "_score"


def test_toxicity_learns_and_never_reads_held_out_labels(spark, odd, none):
    rng = random.Random(1)
    clean = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 8 == 0
        w = [rng.choice(clean) for _ in range(rng.randint(5, 60))] + (["nastyword"] if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        if i % 3:
            # labels of held-out rows say the opposite: a model that read them would be spoiled
            out = zlib.crc32(str(i).encode()) % 4 == 2
            labels.append((i, int(toxic != out)))
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    got = toxicity.score(docs, model)
    assert got.columns == [*docs.columns, "_score"]
    for r in got.collect():
        assert (r._score >= 0.3) == (r.doc_id % 8 == 0), r.doc_id
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r._score <= 1 for r in scored)
    assert toxicity.score(none, model).count() == 0
    nobody = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert len({r._score for r in toxicity.score(odd, nobody).collect()}) == 1
    toxicity.train(none, known)


def test_the_sample_of_the_classifier_is_ordered_without_a_copy():
    kinds, ids = [1, 0, 1, 0], [3, 9, 2, 1]
    features = [np.full(50_000, i, "<u4") for i in range(4)]
    half = lambda a, b: pa.record_batch({"kind": kinds[a:b], "doc_id": ids[a:b], "features": [f.tobytes() for f in features[a:b]]})
    rows = pa.Table.from_batches([half(0, 2), half(2, 4)])
    before = pa.total_allocated_bytes()
    pos, unl = toxicity.by_kind(rows)
    assert [int(f[0]) for f in pos] == [2, 0] and [int(f[0]) for f in unl] == [3, 1]
    assert all(len(f) == 50_000 for f in pos + unl) and pa.total_allocated_bytes() - before < 50_000
