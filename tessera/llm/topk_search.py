"""Exact top-k search with vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, stored

K = 10
#: Components are floored after this scaling.
SCALE = 1024
#: Cells per dimension of the approximation.
CELLS = 64
#: Vectors and queries of one block; a block pair is one unit of the approximate scan.
BLOCK, QUERY_BLOCK = 16384, 32768
#: Rows and queries of one matrix product inside a block pair.
TILE, QUERY_TILE = 4096, 256


#: Integers up to this size, and sums of products that stay below it, are exact in double precision.
EXACT = float(1 << 53)


def integral(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale x component) for every component as a long; null where the vector takes no part.

    A vector takes no part if it is null or empty, or holds a null or a non-finite component. A component that no
    long can hold after scaling is an error, not a row less.
    """
    wide = F.transform(vector, lambda x: x.cast("double") * float(scale))
    fine = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    held = lambda x: F.when(F.abs(x) < 2.0**63, F.floor(x).cast("long")).otherwise(F.raise_error(F.lit("a scaled component exceeds a long")).cast("long"))
    return F.when((F.size(vector) > 0) & fine, F.transform(wide, held))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, lows, highs, n) of each length of vector in a batch."""
    for batch in batches:
        vectors, dims = batch["v"], batch["dim"].to_numpy()
        for dim in np.unique(dims).tolist():
            v = _matrix(vectors.filter(pa.array(dims == dim)), dim)
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([v.min(axis=0)]), pa.array([v.max(axis=0)]), pa.array([len(v)])], ["dim", "lows", "highs", "n"])


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = pa.concat_arrays([c.flatten() for c in vectors.chunks]) if isinstance(vectors, pa.ChunkedArray) else vectors.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _approximate(grids: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Cell numbers of each vector on its dimension's grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                low, width = grids[dim]
                cells = np.minimum((_matrix(part["v"], dim) - low) // width, CELLS - 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part["rid"], part["vec_id"], part["dim"], part["block"], pa.array([c.tobytes() for c in cells], pa.binary())], ["rid", "vec_id", "dim", "block", "cells"])

    return run


def _scan(grids: dict[int, tuple[np.ndarray, np.ndarray]], k: int, floors_only: bool = False):
    """Bounds of every score in a block pair; rows that k others, of the block or met before, surely beat are left out.

    Bounds are widened by what rounding can add where sums of products leave the exact range of a double.
    ``floors_only`` gives the kth lower bound of each query alone.
    """

    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        low, width = (x.astype(np.float64) for x in grids[dim])
        out: list[tuple[np.ndarray, ...]] = []
        qs, known = _matrix(queries["v"], dim).astype(np.float64), queries["floor"].to_numpy()
        qid, rid, vid = queries["qid"].to_numpy(), rows["rid"].to_numpy(), rows["vec_id"].to_numpy()
        cells = np.frombuffer(b"".join(rows["cells"].to_pylist()), np.uint8).reshape(-1, dim)
        reach = float(np.maximum(np.abs(low), np.abs(low + CELLS * width)).sum())
        for i in range(0, len(qs), QUERY_TILE):
            q, ids, least_known = qs[i : i + QUERY_TILE], qid[i : i + QUERY_TILE], known[i : i + QUERY_TILE]
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            most_sum = reach * float(np.abs(q).max())
            slack = 0.0 if most_sum < EXACT else most_sum * (dim + 8) * 2.0**-52
            floor = np.full((len(q), k), -np.inf)  # the k best lower bounds so far
            held: list[tuple[np.ndarray, ...]] = []
            for j in range(0, len(cells), TILE):
                least = low + cells[j : j + TILE] * width
                most = least + (width - 1)
                upper, lower = up @ most.T + down @ least.T + slack, up @ least.T + down @ most.T - slack
                own = ids[:, None] == rid[None, j : j + TILE]
                lower[own], upper[own] = -np.inf, -np.inf
                both = np.concatenate([floor, lower], axis=1)
                floor = -np.partition(-both, k - 1, axis=1)[:, :k]
                if not floors_only:
                    r, c = np.nonzero((upper >= np.maximum(floor.min(axis=1), least_known)[:, None]) & ~own)
                    held.append((r, rid[j + c], vid[j + c], lower[r, c], upper[r, c]))
            if floors_only:
                out.append((ids, floor.min(axis=1)))
                continue
            r, rows_met, v, lo, hi = (np.concatenate(x) for x in zip(*held, strict=True))
            stay = hi >= floor.min(axis=1)[r]
            out.append((ids[r[stay]], rows_met[stay], v[stay], lo[stay], hi[stay]))
        names = ["qid", "floor"] if floors_only else ["qid", "rid", "vec_id", "lower", "upper"]
        return pa.table(dict(zip(names, (pa.array(np.concatenate(x)) for x in zip(*out, strict=True)), strict=True)))

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = 100, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each query with all other rows, exactly.

    Queries are the rows whose id is divisible by ``every``; a row is no candidate of its own query,
    ties go to the smaller id. Vectors take part as ``integral`` says, and meet queries of
    their own length only. A null id takes no part. Rows that share an id are rows like others: each is a
    candidate, and each that is a query has its own k results. A score that no long can hold is an error.
    Equal vectors: only the k + 1 smallest ids can be among any k best, so only
    they are scanned. No rows give no rows.

    The approximation file holds one byte per component: its cell on the grid of
    its dimension. One block of it gives each query a first proven floor; then every block is scanned
    against every block of queries for bounds of the scores. What k rows of the block surely beat, or that floor does, stops there, and then
    what k rows of all blocks surely beat. Exact vectors are then read in bound order: the k most promising
    candidates first, after which the kth score is a proven floor; then those whose
    bound reaches that floor, and no others.
    """
    vec = integral(quoted(vector_col)[0], scale)
    ids = vectors.select(quoted(id_col)[0].cast("long").alias("vec_id"), vec.alias("v")).where("vec_id is not null and v is not null")
    exact = stored(ids.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v", F.size("v").alias("dim")), "vectors")
    seen = exact.select("dim", "v").mapInArrow(_spread, "dim int, lows array<long>, highs array<long>, n long")
    # One row per length of vector reaches the driver, with its grid and count.
    least = seen.select("dim", "n", F.posexplode(F.arrays_zip("lows", "highs")).alias("pos", "x")).groupBy("dim", "pos").agg(F.min("x.lows").alias("low"), F.max("x.highs").alias("high"), F.sum("n").alias("n"))
    grids, counts, large = {}, {}, False
    for dim, low, high, n in least.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("pos", "low", "high"))).alias("g"), F.max("n").alias("n")).select("dim", "g.low", "g.high", "n").collect():
        grids[dim], counts[dim] = (np.array(low), np.array([max(1, -(-(h - b + 1) // CELLS)) for b, h in zip(low, high, strict=True)])), n
        large = large or sum(max(abs(b), abs(h)) ** 2 for b, h in zip(low, high, strict=True)) >= 1 << 63
    same = F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "rid"))
    slim = exact.withColumn("same", same).where(F.col("same") <= k + 1)
    blocks = query_blocks = F.lit(1)
    for dim, n in counts.items():
        blocks = F.when(F.col("dim") == dim, -(-n // BLOCK)).otherwise(blocks)
        query_blocks = F.when(F.col("dim") == dim, -(-n // (every * QUERY_BLOCK))).otherwise(query_blocks)
    file = stored(
        slim.select("rid", "vec_id", "v", "dim", F.pmod(F.xxhash64("rid"), blocks).cast("int").alias("block")).mapInArrow(_approximate(grids), "rid long, vec_id long, dim int, block int, cells binary"),
        "approximations",
    )
    queries = exact.where(F.col("vec_id") % every == 0).select(F.col("rid").alias("qid"), F.col("vec_id").alias("query_id"), "v", "dim", F.pmod(F.xxhash64("rid"), query_blocks).cast("int").alias("query_block"))
    pair = ["dim", "block", "query_block"]
    # Each block pair is one group: queries go to every block of rows, rows to every block of queries.
    spread = file.withColumn("query_block", F.explode(F.sequence(F.lit(0), query_blocks.cast("int") - 1)))
    start = queries.select("*", F.lit(0).alias("block"), F.lit(float("-inf")).alias("floor"))
    floors = start.groupBy(*pair).cogroup(spread.where("block = 0").groupBy(*pair)).applyInArrow(_guarded(_scan(grids, k, True), "qid", "floor"), "qid long, floor double")
    floors = stored(floors, "first-floors")
    known = queries.join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    left = known.withColumn("block", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1))).groupBy(*pair)
    right = spread.select(*[F.col(c).alias(c) for c in spread.columns]).groupBy(*pair)
    near = stored(left.cogroup(right).applyInArrow(_guarded(_scan(grids, k), "qid", "rid", "vec_id", "lower", "upper"), "qid long, rid long, vec_id long, lower double, upper double"), "bounds")
    by_query = Window.partitionBy("qid")
    sure = near.withColumn("r", F.row_number().over(by_query.orderBy(F.desc("lower"), "vec_id", "rid"))).where(F.col("r") <= k).groupBy("qid").agg(F.min("lower").alias("floor"), F.count("*").alias("n"))
    open_ = near.join(sure, "qid").where((F.col("upper") >= F.col("floor")) | (F.col("n") < k)).select("qid", "rid", "vec_id", "upper")
    ranked = stored(open_.withColumn("turn", F.row_number().over(by_query.orderBy(F.desc("upper"), "vec_id", "rid"))), "candidates")

    def scored(pairs: DataFrame) -> DataFrame:
        q, c = exact.select(F.col("rid").alias("qid"), F.col("vec_id").alias("query_id"), F.col("v").alias("q")), exact.select("rid", "v")
        kind = "decimal(38,0)" if large else "long"  # products of longs fit 38 digits
        dot = F.aggregate(F.zip_with("q", "v", lambda x, y: (x.cast("decimal(19,0)") * y.cast("decimal(19,0)")).cast(kind) if large else x * y), F.lit(0).cast(kind), lambda s, x: (s + x).cast(kind))
        if large:
            dot = F.when(F.abs(dot) < F.lit(str(1 << 63)).cast(kind), dot.cast("long")).otherwise(F.raise_error(F.lit("a score exceeds a long")).cast("long"))
        return pairs.join(c, "rid").join(q, "qid").select("qid", "query_id", "rid", "vec_id", dot.alias("score"))

    first = stored(scored(ranked.where(F.col("turn") <= k)), "first-read")
    kth = first.groupBy("qid").agg(F.min("score").cast("double").alias("kth"))
    later = scored(ranked.where(F.col("turn") > k).join(kth, "qid").where("upper >= kth").select("qid", "rid", "vec_id"))
    place = F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id", "rid"))
    return first.unionByName(later).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _guarded(scan, *names: str):
    """A block pair without queries or without rows has no scores."""
    empty = pa.table({c: pa.array([], pa.float64() if c in ("floor", "lower", "upper") else pa.int64()) for c in names})

    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        return scan(key, queries, rows) if queries.num_rows and rows.num_rows else empty

    return run
