"""Hard negatives by the inverted multi-index against all products."""

from collections import Counter

import numpy as np
import pytest

from nimbus.llm import catalog, hard_negatives
from tests.oracle_util import compare, duck


def brute(rows, anchors, positives=5, negatives=3):
    out = Counter()
    for a, label, q in anchors:
        scores = sorted((-int(q @ v), i, other) for i, other, v in rows if i != a)
        near = [(i, -s) for s, i, other in scores if other == label][:positives]
        for pid, ps in near:
            hard = [(i, -s) for s, i, other in scores if other != label and 50 * ps <= 100 * -s <= 95 * ps][:negatives]
            for rank, (i, s) in enumerate(hard, 1):
                out[(a, pid, rank, i, ps, s)] += 1
    return out


def table(spark, rows):
    full = [(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", "y") for i, label, v in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, label int, score string, cell string").repartition(3)


def whole(t):
    rows = [(r.vec_id, r.label, r.embedding) for r in t.collect()]
    keep = [r for r in rows if r[0] is not None and r[1] is not None and r[2] and all(x is not None and np.isfinite(x) for x in r[2])]
    return [(i, label, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, label, v in keep]


def sample(n, dim, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(i, int(rng.integers(0, 3)), centres[rng.integers(0, 12)] + spread * rng.normal(size=dim)) for i in range(n)]


@pytest.mark.parametrize(("dim", "spread", "probe"), [(8, 0.2, 40), (7, 1.5, 1), (2, 0.5, 10_000)])
def test_equals_all_products(spark, dim, spread, probe):
    rows = sample(400, dim, dim, spread)
    rows += [(1000 + i, 1, rows[50][2]) for i in range(120)]  # one hot vector, in one cell with more than a block
    rows += [(2000, 1, None), (None, 1, rows[0][2]), (2001, None, rows[0][2]), (2002, 1, [float("nan")] * dim), (2003, 0, [None] * dim), (2004, 0, [0.0] * dim), (2005, 1, [float("inf")] * dim)]
    rows += [(2006, 2, rows[100][2]), (2006, 2, rows[100][2])]  # a row that is there twice
    t = table(spark, rows)
    q = hard_negatives.quantized(t)
    got = hard_negatives.mine(q, q.where("vec_id % 50 = 0"), codes=5, probe_rows=probe, block_rows=30, ask_rows=3).collect()
    every = whole(t)
    assert Counter(tuple(r) for r in got) == brute(every, [r for r in every if r[0] % 50 == 0])


def test_the_walk_descends_and_covers_every_cell(spark):
    rows = hard_negatives.quantized(table(spark, sample(300, 6, 1, 0.3)))
    index, lists = hard_negatives.build(rows, 6, 50, 8192)
    v = np.array([30, -200, 10, 90, 5, -40])
    steps = list(index.walk(v))
    assert [s[0] for s in steps] == pytest.approx(sorted((s[0] for s in steps), reverse=True), abs=1e-2)
    assert len({s[1] for s in steps}) == len(steps) == (index.size > 0).sum()
    held = {}
    for r in lists.collect():
        ids = np.frombuffer(r.ids, np.int64)
        assert len(ids) <= 50 * 2  # a block of about 50 rows
        held.setdefault(r.cell, []).extend((hard_negatives.widen(r.data, len(ids)) @ v).tolist())
    assert sum(map(len, held.values())) == 300
    for bound, cell, least, most in steps:
        assert least <= min(held[cell]) and max(held[cell]) <= most <= bound + 1e-2


def test_clustered_vectors_leave_cells_out(spark):
    """Tight clusters: the certified walk visits few of the rows' cells."""
    rows = hard_negatives.quantized(table(spark, sample(2000, 16, 3, 0.02)))
    index, _ = hard_negatives.build(rows, 12, 500, 8192)
    seen = []
    for r in rows.where("vec_id % 50 = 0").collect():
        window = [(hard_negatives.NOTHING, -hard_negatives.NOTHING, int(np.array(r.v) @ np.array(r.v) * 0.9))]
        cells = [*hard_negatives.plan_probe(index, np.array(r.v), window, 100), *hard_negatives.plan_rest(index, np.array(r.v), window, 100)]
        assert len(cells) == len(set(cells))
        seen.append(sum(int(index.size.flat[c]) for c in cells) / 2000)
    assert np.mean(seen) < 0.25


def test_empty_lonely_and_negative(spark):
    none = hard_negatives.quantized(table(spark, []))
    assert hard_negatives.mine(none, none).count() == 0
    t = table(spark, [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 2, [0.5, 0.0]), (50, 3, [0.3, 0.1]), (3, 2, [0.0, 1.0])])
    q = hard_negatives.quantized(t)
    every = whole(t)
    got = hard_negatives.mine(q, q.where("vec_id % 50 = 0"))
    assert Counter(tuple(r) for r in got.collect()) == brute(every, [r for r in every if r[0] % 50 == 0])
    assert hard_negatives.mine(q, q.where("false")).count() == 0


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert compare(catalog.queries()["op13_hard_negatives"](spark, sf_dir), duck(sf_dir), catalog.oracle_sql()["op13_hard_negatives"]) is None
