"""Running aggregates against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import scan


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def rows(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot", "hot", "hot", "b", "c", None]), i, rng.choice([None, 1, 5, 9])) for i in range(400)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, t long, v long").repartition(7)


def test_running_equals_a_loop(spark, rows):
    data, df = rows
    kinds = {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "top": ("max", F.col("v")), "low": ("min", F.col("v")), "x": ("bit_xor", F.col("v")), "seen": ("last", F.col("v"))}
    got = {(r["k"], r["t"]): r for r in scan.running(df, ["k"], ["t"], kinds).collect()}
    assert len(got) == 400
    state = {}
    for k, t, v in sorted(data, key=lambda r: r[1]):
        seen = state.setdefault(k, [])
        seen.append(v)
        known = [x for x in seen if x is not None]
        r, xor = got[k, t], 0
        for x in known:
            xor ^= x
        assert (r["n"], r["s"], r["top"], r["low"], r["seen"]) == (len(seen), sum(known) if known else None, max(known, default=None), min(known, default=None), known[-1] if known else None)
        assert r["x"] == xor or not known


def test_a_hot_key_spreads_over_ranges(spark):
    df = spark.range(20_000).select(F.lit("one").alias("k"), "id")
    cut = df.repartitionByRange("k", "id")
    assert cut.select(F.spark_partition_id()).distinct().count() > 1
    got = scan.running(df, ["k"], ["id"], {"n": ("count", F.lit(1))})
    assert got.where("n <> id + 1").count() == 0 and got.count() == 20_000


def test_empty(spark):
    assert scan.running(spark.createDataFrame([], "k string, t long"), ["k"], ["t"], {"n": ("count", F.lit(1))}).count() == 0
