"""Many queries at a time in a task: the best entries of each, as one query after the other has them."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import bm25


def share(terms: int, entries: int, queries: int, holes: bool) -> pa.Table:
    """Posting lists of a share, some of which most entries are in, with what queries ask of them; the last row names the entries that are left."""
    draw = np.random.default_rng(2)
    rows = []
    for t in range(terms):
        idx = np.sort(draw.choice(entries, draw.integers(1, entries if t % 10 == 0 else entries // 20), replace=False))
        asked = [{"query_id": f"q{q}", "w": float(draw.choice([0.5, 1.0, draw.random()]))} for q in np.flatnonzero(draw.random(queries) < 0.2)]
        rows.append({"token": f"t{t}", "idx": idx.tolist(), "tf": draw.integers(1, 3, len(idx)).tolist(), "dl": [4 + i % 3 for i in idx.tolist()], "qs": asked})
    if holes:
        rows.append({"token": None, "idx": list(range(0, entries, 2)), "tf": None, "dl": None, "qs": None})
    kind = pa.list_(pa.int32())
    types = {"seq": pa.int64(), "is_title": pa.bool_(), "share": pa.int32(), "token": pa.string(), "idx": kind, "tf": kind, "dl": kind, "qs": pa.list_(pa.struct({"query_id": pa.string(), "w": pa.float64()}))}
    return pa.Table.from_pylist([{"seq": 0, "is_title": False, "share": 3} | r for r in rows], pa.schema(list(types.items())))


def rows_of(table: pa.Table) -> set:
    return {(r["query_id"], i, s) for r in table.to_pylist() for i, s in zip(r["idx"], r["score"], strict=True)}


@pytest.mark.parametrize(("entries", "limit", "cells"), [(600, 7, 1 << 22), (600, 7, 2000), (90, 40, 1 << 22)])
@pytest.mark.parametrize("holes", [False, True])
def test_all_at_once_gives_what_each_gives(monkeypatch, entries, limit, cells, holes):
    table = share(60, entries, 50, holes)
    answer = lambda most: rows_of(bm25._answer(most, None if holes else set(), 5.0, pa.string(), None)(table))
    ranked: dict[str, list] = {}
    for q, i, s in answer(None):
        ranked.setdefault(q, []).append((-s, i))
    expected = {(q, i, -s) for q, found in ranked.items() for s, i in sorted(found)[:limit]}
    assert answer(limit) == expected
    monkeypatch.setattr(bm25, "MANY", 1)
    monkeypatch.setattr(bm25, "SCORED_CELLS", cells)
    assert answer(limit) == expected


def test_merging_keeps_ties_and_nothing_below_them():
    kind = {"query_id": pa.string(), "seq": pa.int64(), "is_title": pa.bool_(), "share": pa.int32(), "idx": pa.list_(pa.int32()), "score": pa.list_(pa.float64())}
    rows = [("a", 0, [1, 2, 3], [5.0, 3.0, 1.0]), ("b", 0, [4], [1.0]), ("a", 1, [1, 9], [3.0, 2.0])]
    table = pa.Table.from_pylist([{"query_id": q, "seq": 0, "is_title": False, "share": s, "idx": i, "score": x} for q, s, i, x in rows], pa.schema(list(kind.items())))
    out = [(r["query_id"], r["share"], r["idx"], r["score"]) for r in bm25._merge(2)(table).to_pylist()]
    assert sorted(out) == [("a", 0, 1, 5.0), ("a", 0, 2, 3.0), ("a", 1, 1, 3.0), ("b", 0, 4, 1.0)]
