"""Flat vector search: exact cosine of a block of queries with every vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators.ranking import top_per_query

#: Queries that one pass over the vectors answers; more are answered by more passes.
QUERY_BLOCK = 4096
DIGITS = 6
#: Vectors of either side that a row of ``all_cosines`` holds, the tasks that these rows are dealt to at most, and rows of a result batch.
PAIR_BLOCK, PAIR_TASKS, PAIR_ROWS = 1024, 4096, 1 << 16


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def broken(vector: Column) -> Column:
    return F.exists(vector, F.isnan)


def _block(ids: list, matrix: np.ndarray, limit: int, q_type: pa.DataType):
    norms = np.linalg.norm(matrix, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for r in zip(batch["id"].to_pylist(), batch["embedding"].to_pylist(), strict=True) if r[1] is not None]
            if not rows:
                continue
            if bad := [i for i, v in rows if len(v) != matrix.shape[1]]:
                raise ValueError(f"vectors of another length: {bad[:5]}")
            v = np.array([v for _, v in rows], np.float64)
            if np.isnan(v).any():
                raise ValueError(f"vectors with NaN: {[rows[i][0] for i in np.flatnonzero(np.isnan(v).any(axis=1))[:5]]}")
            norm = norms[:, None] * np.linalg.norm(v, axis=1)[None, :]
            score = np.round(np.divide(matrix @ v.T, norm, out=np.zeros_like(norm), where=norm > 0), DIGITS)
            keys = np.array([r[0] for r in rows])
            order = np.argsort(keys, kind="stable")
            best = order[np.argsort(-score[:, order], axis=1, kind="stable")[:, :limit]]
            q = np.repeat(np.arange(len(ids)), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], q_type), pa.array(keys[best.reshape(-1)].tolist(), batch["id"].type), pa.array(score[q, best.reshape(-1)])], ["query_id", "id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, score, rank): the ``limit`` vectors (id, embedding) nearest to each query (query_id, embedding).

    Tasks keep the best of each Arrow batch, so what reaches the shuffle is ``limit`` rows per query and batch.
    A vector with NaN or of another length stops the search, naming it; a vector without length scores 0.
    """
    asked = queries.select("query_id", "embedding").where("embedding is not null").orderBy("query_id")
    n = asked.count()
    id_type, q_type = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    arrow_type = to_arrow_type(queries.schema["query_id"].dataType)
    schema = f"query_id {q_type}, id {id_type}, score double"
    found = queries.sparkSession.createDataFrame([], schema)
    for first in range(0, n, QUERY_BLOCK):
        block = asked.offset(first).limit(QUERY_BLOCK).collect()
        matrix = np.array([r["embedding"] for r in block], np.float64)
        if np.isnan(matrix).any():
            raise ValueError("a query vector holds NaN")
        part = vectors.select("id", "embedding").mapInArrow(_block([r["query_id"] for r in block], matrix, limit, arrow_type), schema)
        found = part if first == 0 else found.unionByName(part)
    return top_per_query(found, limit, "id")


def _plain(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components end to end, where each vector starts, and its length; -1 for vectors that are null or hold a null."""
    lens = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, start = vectors.flatten(), np.cumsum(lens) - lens
    known = vectors.is_valid().to_numpy(zero_copy_only=False)
    if flat.null_count:
        hole = np.append(0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False)))
        known &= hole[start + lens] == hole[start]
    return flat.cast(pa.float64()).to_numpy(zero_copy_only=False), start, np.where(known, lens, -1)


def _in_turn(products: np.ndarray) -> np.ndarray:
    """Sums along the rows, a term after the other."""
    return np.add.accumulate(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def _rounded_cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Each cosine to ``DIGITS`` digits as SQL engines have it: terms are added in turn, halves go away from zero.

    A matrix product adds in another order, so what it puts next to a half is added up once more, in turn.
    """
    nx, ny = _in_turn(x * x), _in_turn(y * y)
    norm = np.sqrt(nx[:, None] * ny[None, :])
    cos = np.divide(x @ y.T, norm, out=np.where(np.isnan(norm), np.nan, 0.0), where=norm > 0)
    size = np.abs(cos) * 10.0**DIGITS
    near = np.rint(size)
    i, j = np.nonzero(np.abs(np.abs(size - near) - 0.5) < 1e-6)
    if len(i):
        cos[i, j] = _in_turn(x[i] * y[j]) / norm[i, j]
        size[i, j] = np.abs(cos[i, j]) * 10.0**DIGITS
        near[i, j] = np.rint(size[i, j])
    near += size - near == 0.5
    return np.clip(np.copysign(near, cos) / 10.0**DIGITS, -1.0, 1.0)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            left, right = (batch[c][r].values for c in ("left", "right"))
            (a, x), (b, y) = ((s.field("id"), s.field("v")) for s in (left, right))
            code = pa.concat_arrays([a, b]).dictionary_encode().indices.to_numpy()
            ca, cb = code[: len(a)], code[len(a) :]
            (fx, sx, lx), (fy, sy, ly) = _plain(x), _plain(y)
            kinds = [(np.flatnonzero(ly == n), n) for n in np.intersect1d(lx, ly).tolist() if n >= 0]
            sides = [(vi, fy[sy[vi][:, None] + np.arange(n)], n) for vi, n in kinds]
            step = max(1, PAIR_ROWS // max(1, len(b)))
            for first in range(0, len(a), step):
                own = np.arange(first, min(first + step, len(a)))
                score, none = np.full((len(own), len(b)), np.nan), np.ones((len(own), len(b)), bool)
                for vi, m, n in sides:
                    qi = np.flatnonzero(lx[own] == n)
                    at = np.ix_(qi, vi)
                    score[at], none[at] = _rounded_cosines(fx[sx[own[qi]][:, None] + np.arange(n)], m), False
                q, v = np.nonzero(ca[own][:, None] != cb[None, :])
                scores = pa.array(score[q, v], mask=none[q, v]) if none.any() else pa.array(score[q, v])
                yield pa.RecordBatch.from_arrays([a.take(pa.array(own[q])), b.take(pa.array(v)), scores], ["a", "b", "score"])


def all_cosines(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, score): the rounded cosine of each vector of ``left`` (id, embedding) with each of ``right`` that has another id.

    Vectors are packed into rows of about ``PAIR_BLOCK``; every two of these meet in a task as a matrix product. Null where a vector is null, holds a null
    or has another length than the other; 0 where one has no length.
    """
    packed, count = [], 1
    for name, side in (("left", left), ("right", right)):
        blocks = max(1, -(-side.count() // PAIR_BLOCK))
        held = side.where("id is not null").select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.struct("id", F.col("embedding").alias("v")).alias("s"))
        packed.append(held.groupBy("block").agg(F.collect_list("s").alias(name)).select(name))
        count *= blocks
    kind = {side: df.schema["id"].dataType.simpleString() for side, df in (("a", left), ("b", right))}
    return packed[0].crossJoin(packed[1]).repartition(min(count, PAIR_TASKS)).mapInArrow(_pairs, f"a {kind['a']}, b {kind['b']}, score double")
