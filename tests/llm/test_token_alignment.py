"""Alignment of two tokenizers against a token-by-token account."""

import hashlib
from collections import Counter, deque

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nimbus.llm import token_alignment as ta
from tests.llm.conftest import ROWS, frame


@pytest.fixture(scope="module")
def sides():
    a, b = ta.files()
    return ta.ByteSide(a), ta.PieceSide(b)


def account(docs, a, b):
    """Per row: n_a, n_b, groups, links, best links, sum of counts; every token span compared."""
    per, counts = [], Counter()
    for _, text in docs:
        ia, ib = (a.encode([text])[0], b.encode([text])[0]) if text else ([], [])
        raw = b" " + (text or "").encode()
        if b"".join(a.bytes_of[i] for i in ia) != raw or b"".join(b.bytes_of[i] for i in ib) != raw:
            ia, ib = [], []
        ra, rb = spans(ia, a), spans(ib, b)
        both = sorted({e for _, _, e in ra} & {e for _, _, e in rb})
        groups, rest_a, rest_b = [], deque(ra), deque(rb)
        for hi in both:
            groups.append("|".join(",".join(taken(rest, hi)) for rest in (rest_a, rest_b)))
        links = [(i, j) for i, s, e in ra for j, t, f in rb if s < f and t < e] if len(ra) < 500 else swept(ra, rb)
        counts.update(set(links))
        per.append((len(ia), len(ib), len(both), len(links), ";".join(groups), links))
    best = Counter()
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return [(*p[:5], sum(counts[x] == best[x[0]] for x in p[5]), sum(counts[x] for x in p[5])) for p in per], counts


def taken(rest, hi):
    out = []
    while rest and rest[0][2] <= hi:
        out.append(str(rest.popleft()[0]))
    return out


def spans(ids, side):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(side.bytes_of[i])))
        at = out[-1][2]
    return out


def swept(ra, rb):
    out, j = [], 0
    for i, s, e in ra:
        while rb[j][2] <= s:
            j += 1
        k = j
        while k < len(rb) and rb[k][1] < e:
            out.append((i, rb[k][0]))
            k += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 120)), st.sets(st.integers(1, 120)), st.integers(0, 120)), max_size=4))
def test_divide_and_conquer_finds_all_common_ends(texts):
    a, b, first, base = [], [], [0], 0
    for ends_a, ends_b, length in texts:
        if length:
            a += [base + x for x in sorted({x for x in ends_a if x < length} | {length})]
            b += [base + x for x in sorted({x for x in ends_b if x < length} | {length})]
            base += length
        first.append(len(a))
    if a:
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        assert (ta.common_ends(a, b, np.array(first)) == np.isin(a, b)).all()


def test_codes_come_back():
    codes, times = np.array([0, 3, 4, 70_000, 2**31]), np.array([1, 2, 1, 300, 70_000])
    back = ta.unpack_codes(ta.pack_codes(codes, times))
    assert (back[0] == codes).all() and (back[1] == times).all()
    assert all(len(x) == 0 for x in ta.unpack_codes(ta.pack_codes(codes[:0], times[:0])))


MORE = [(20, "<|endoftext|> <s> </s> <0x0A> <unk>"), (21, "a▁b"), (22, "  two  spaces\n\n\ttab "), (23, " "), (24, "中文字 \U00010348 � é"), (25, "x" * 3000 + " " * 3000), (26, "\x00null")]


@pytest.mark.parametrize("slice_bytes", [1, 4_000_000])
def test_against_the_account_of_every_token(spark, sides, slice_bytes):
    docs = [r for r in ROWS if not r[1] or len(r[1]) < 30_000] + MORE
    expected, counts = account(docs, *sides)
    aligned = ta.store(ta.align(frame(spark, docs).repartition(2), *ta.files(), slice_bytes=slice_bytes))
    got = ta.with_counts(aligned).collect()
    rows = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in got)
    assert rows == Counter((d, *e) for (d, _), e in zip(docs, expected, strict=True))
    assert {(r.a_id, r.b_id): r.docs for r in ta.pair_counts(aligned).collect()} == dict(counts)
    empty = {r.doc_id for r in got if r.n_a == 0}
    assert empty >= {4, 5, 21} and not empty & {20, 22, 23, 25}


def test_long_text_and_query(spark, sides):
    long = [r for r in ROWS if r[0] in (10, 11)]
    expected, _ = account(long, *sides)
    got = ta.with_counts(ta.store(ta.align(frame(spark, long), *ta.files()))).orderBy("doc_id").collect()
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in got] == expected
    found = ta.op12_token_alignment(spark, "/root/testdata/sf0.001")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    by = {d: e for (d, _), e in zip(docs, account(docs, *sides)[0], strict=True)}
    for r in found.collect():
        n_a, n_b, n_groups, n_links, groups, n_best, count_sum = by[r.doc_id]
        digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) == (n_a, n_b, n_groups, n_links, digest, n_best, count_sum)


def test_empty_table(spark, none):
    assert ta.with_counts(ta.store(ta.align(none, *ta.files()))).count() == 0
