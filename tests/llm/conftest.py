"""Small fixtures: documents with odd rows, and columns whose names clash with working names."""

import pytest
from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and then runs far away from the old stone house today"),
    (2, "THE quick brown fox jumps over the lazy dog and then runs far away from the old stone house today"),
    (3, "the quick brown fox jumps over the lazy dog and then runs far away from the old stone house tonight"),
    (4, None),
    (5, ""),
    (6, " \t\n "),
    (7, "one two"),
    (8, "one two"),
    (8, "one two"),
    (9, "é ß 漢字 😀 naïve\u00a0space\x0bvt"),
    (10, LONG),
    (11, LONG + " end"),
    (None, "the quick brown fox jumps over the lazy dog and then runs far away from the old stone house today"),
    (None, None),
    (12, "a" * 20_000),
    (13, "alpha " * 50),
]

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("score", "block", "key", "id", "kind", "size", "n", "component", "bucket")]
)


def frame(spark, rows):
    full = [(i, t, None, "s", None if t is None else len(t), *["x"] * 9) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture
def odd(spark):
    return frame(spark, ROWS).repartition(3)


@pytest.fixture
def none(spark):
    return frame(spark, [])
