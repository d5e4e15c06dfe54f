"""Arrow functions hold a bounded part of a batch at a time."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import udfs


def test_portions_are_bounded():
    texts = [None, "", "x" * 50, *["abc"] * 700, "y" * 5000, "z" * 10]
    parts = [p.to_pylist() for p in udfs.portions(pa.array(texts), rows=100, size=1000)]
    assert sum(parts, []) == texts and max(map(len, parts)) <= 100
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 1000 for p in parts)
    assert [p.to_pylist() for p in udfs.portions(pa.array([[1, 2], None, [3]]).slice(1), size=1)] == [[None, [3]]]


@pytest.fixture
def sizes(monkeypatch):
    """How many values each portion has, in whatever process."""
    real = udfs.batched
    monkeypatch.setattr(udfs, "batched", lambda fn, kind, size=udfs.SIZE: real(lambda ts: pa.array([len(ts)] * len(ts), pa.int32()), "int", size))


def test_entities_work_on_portions(spark, sizes):
    df = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("Marta "), 10).alias("t"))
    assert df.select(udfs.entities(F.col("t")).alias("n")).agg(F.max("n")).first()[0] <= udfs.ROWS


def test_html_work_on_portions(spark, sizes):
    df = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("Marta "), 10).alias("t"))
    assert df.select(udfs.html_text(F.col("t")).alias("n")).agg(F.max("n")).first()[0] <= udfs.ROWS


@pytest.mark.parametrize("spec", ["sentence:500:1", "recursive:500:50"])
def test_chunks_work_on_portions(spark, sizes, spec):
    df = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("Marta "), 10).alias("t"))
    assert df.select(udfs.chunks(F.col("t"), T.Chunker.parse(spec)).alias("n")).agg(F.max("n")).first()[0] <= udfs.ROWS
