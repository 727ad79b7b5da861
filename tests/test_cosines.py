"""All pairs of cosines by blocks, against the SQL of fn3_cosine."""

from random import Random

import numpy as np
import pytest

from tessera.jobs import catalog
from tessera.operators import vector


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(vector, "PAIR_BLOCK", 7)
    monkeypatch.setattr(vector, "PAIR_ROWS", 20)


def test_blocks_give_what_the_sql_gives(spark, tmp_path, small):
    duckdb = pytest.importorskip("duckdb")
    draw = Random(5)
    rows = [(i, [draw.choice([-1.0, 1e-9, 0.5, draw.random()]) for _ in range(4)]) for i in range(100)] + [(100, [1.0, 0.0, 0.0, 0.0]), (101, [-1e-8, 1.0, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = catalog.QUERIES["fn3_cosine"](spark, str(tmp_path)).select("a", "b", "score").collect()
    assert len(got) == 6 * 101
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(f"SELECT a, b, score FROM ({catalog.ORACLES['fn3_cosine']})").fetchall()))


def test_vectors_that_have_no_cosine(spark, small):
    odd = [("n", None), ("h", [1.0, None]), ("s", [1.0]), ("z", [0.0, 0.0]), ("x", [1.0, 1.0]), (None, [1.0, 0.0])]
    v = spark.createDataFrame(odd, "id string, embedding array<double>")
    got = {(r["a"], r["b"]): r["score"] for r in vector.all_cosines(v, v.where("id in ('x', 's')")).collect()}
    assert got == {("n", "x"): None, ("h", "x"): None, ("s", "x"): None, ("z", "x"): 0.0, ("n", "s"): None, ("h", "s"): None, ("z", "s"): None, ("x", "s"): None}


def test_a_sum_next_to_a_half_is_added_up_in_turn():
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(40, 64)), draw.normal(size=(50, 64))
    one = lambda p, q: np.add.accumulate(p * q)[-1]
    size = np.array([[one(p, q) / np.sqrt(one(p, p) * one(q, q)) for q in y] for p in x]) * 1e6
    assert np.array_equal(vector._rounded_cosines(x, y), np.copysign(np.floor(np.abs(size) + 0.5), size) / 1e6)
