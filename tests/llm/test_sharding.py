"""Sharding by sampled splitters against one sorted pass over all rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from nimbus.llm import sharding
from tests.llm.conftest import frame


def narrow(docs):
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.crc32(text).alias("crc"), F.xxhash64(text).alias("key"), (sharding.text_bytes(F.col("text")) + 1).alias("size"), "score")


def brute(rows, shards, law):
    """(doc_id, crc, shard, slot) from the whole order; rows equal in key and doc_id are interchangeable."""
    rows = sorted(rows, key=lambda r: (r.key, -(1 << 63) if r.doc_id is None else r.doc_id))
    weight = [r["size"] if law == "bytes" else 1 for r in rows]
    total, before, held, out = sum(weight), 0, [0] * shards, []
    for r, w in zip(rows, weight, strict=True):
        s = (2 * before + w) * shards // (2 * total)
        out.append((r.doc_id, r.crc, s, held[s]))
        held[s] += 1
        before += w
    return out


@pytest.mark.parametrize("law", sharding.LAWS)
def test_shards_equal_one_sorted_pass(spark, odd, law):
    table = narrow(odd)
    got = sharding.assign(table, F.col("key"), F.col("size"), 5, law, F.col("doc_id"), ranges_per_shard=3).collect()
    assert all(r["size"] == r.row["size"] for r in got)
    assert sorted((str(r.row.doc_id), r.row.crc, r.shard, r.slot) for r in got) == sorted((str(d), c, s, n) for d, c, s, n in brute(table.collect(), 5, law))


def test_a_hot_key_is_cut_inside(spark):
    """A third of all rows are one row: its range is subdivided until none is overfull, and shards stay equal."""
    rows = [(1, "hot text")] * 3000 + [(i, f"text {i} " + "x" * (i % 50)) for i in range(2, 6000)]
    table = narrow(frame(spark, rows).repartition(7))
    got = sharding.assign(table, F.col("key"), F.col("size"), 8, "bytes", F.col("doc_id"), ranges_per_shard=16, oversample=2)
    loads = {r["shard"]: (r.n, r.b, r.lo, r.hi) for r in got.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.min("slot").alias("lo"), F.max("slot").alias("hi")).collect()}
    most = max(r["size"] for r in table.collect())
    assert len(loads) == 8 and max(b for _, b, _, _ in loads.values()) - min(b for _, b, _, _ in loads.values()) <= 2 * most
    assert all(lo == 0 and hi == n - 1 for n, _, lo, hi in loads.values())
    keyed = table.select("key", F.col("doc_id").alias("tie"), F.monotonically_increasing_id().alias("at"), "size", F.col("size").alias("weight")).cache()
    total = keyed.agg(F.sum("size")).first()[0]
    _, found = sharding.splitters_of(keyed, total, 128, 2, 11)
    assert all(r["weight"] <= 2 * total / 128 + most for r in found) and sum(r["n"] for r in found) == len(rows)


def test_splitters_start_from_a_poor_sample(spark):
    """One draw for each range leaves overfull ranges behind, which are sampled again."""
    keyed = spark.range(20_000).select(F.xxhash64("id").alias("key"), F.lit(0).cast("long").alias("tie"), F.col("id").alias("at"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("weight"))
    _, found = sharding.splitters_of(keyed, 20_000, 64, 1, 3)
    assert max(r["weight"] for r in found) <= 2 * 20_000 / 64 + 1


def test_few_huge_and_no_rows(spark, none):
    one = narrow(frame(spark, [(1, "a" * 5000), (2, "b"), (3, None)]))
    got = {r.row.doc_id: (r.shard, r.slot) for r in sharding.assign(one, F.col("key"), F.col("size"), 4, "bytes").collect()}
    assert sorted(got) == [1, 2, 3] and all(slot == 0 or slot <= 2 for _, slot in got.values())
    assert sharding.assign(narrow(none), F.col("key"), F.col("size")).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(one, F.col("key"), F.col("size"), law="weight")


def test_files_hold_the_slots_in_order(spark, odd, tmp_path):
    got = sharding.assign(narrow(odd), F.col("key"), F.col("size"), 3, "rows", F.col("doc_id"))
    sharding.write_shards(got, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == odd.count()
    for s in range(3):
        folder = tmp_path / f"shards/shard={s}"
        files = [[r.slot for r in spark.read.parquet(str(f)).collect()] for f in folder.glob("*.parquet")]
        assert all(part == list(range(part[0], part[-1] + 1)) for part in files)
        every = sorted(slot for part in files for slot in part)
        assert every == list(range(len(every)))


def test_query_over_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sharding.op11_sharding(spark, sf).collect()
    assert len(got) == len(docs) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw)) and 0 <= r.shard < 16
