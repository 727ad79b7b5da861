"""Chunk scores to file scores, ranks, and fusion of ranked lists."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
DIGITS = 6
#: Digits of file scores: more than sums, halves and weighted sums of rounded chunk scores have, so none is a tie.
FILE_DIGITS = {"weighted_top_l_sum": 11}


def rounded(x: Column, digits: int = DIGITS) -> Column:
    """``x`` to so many digits as SQL engines round doubles: scaled, then halves away from zero.

    Spark's own round goes by a double's shortest decimal form, in which the sum of 0.25 * a and 0.75 * b can stand just below the half that it is.
    """
    scale = 10.0**digits
    size = F.abs(x) * F.lit(scale)
    near = F.rint(size)  # halves to even
    return F.signum(x) * (near + F.when(size - near == 0.5, 1.0).otherwise(0.0)) / F.lit(scale)


def rank_in_query(key: str) -> Column:
    """Position by score within a query, from 1; ties by key, so positions are unique."""
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))


def top_per_query(scored: DataFrame, limit: int, key: str) -> DataFrame:
    return scored.withColumn("rank", rank_in_query(key)).where(F.col("rank") <= limit)


def aggregate_files(chunks: DataFrame, method: str = "max_p", m: int = 3, l: int = 3, decay: float = 0.95, k: int = RRF_K) -> DataFrame:  # noqa: E741
    """(query_id, file_path, score, top_chunk, chunk_count) of scored chunks (query_id, file_path, chunk_id, score).

    max_p takes the best score; top_m_sum and top_m_avg the first m; rrf_per_doc a sum of 1 / (k + rank)
    that depends on the count alone; weighted_top_l_sum the first l with falling weight.
    """
    ranked = chunks.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "file_path").orderBy(F.desc("score"), "chunk_id")))
    first = lambda n, x: F.sum(F.when(F.col("r") <= n, x))
    methods = {
        "max_p": F.max("score"),
        "top_m_sum": first(m, F.col("score")),
        "top_m_avg": first(m, F.col("score")) / F.least(F.count("*"), F.lit(m)),
        "rrf_per_doc": F.sum(1 / (k + F.col("r"))),
        "weighted_top_l_sum": first(l, F.pow(F.lit(decay), F.col("r") - 1) * F.col("score")),
    }
    if method not in methods:
        raise ValueError(f"unknown aggregation: {method}")
    return ranked.groupBy("query_id", "file_path").agg(
        F.round(methods[method], FILE_DIGITS.get(method, 9)).alias("score"), F.min_by("chunk_id", "r").alias("top_chunk"), F.count("*").alias("chunk_count")
    )


def merge_first(*lists: DataFrame) -> DataFrame:
    """Union of chunk lists (query_id, chunk_id, score, ...); a chunk keeps the row of the first list that has it."""
    tagged = [x.withColumn("source_order", F.lit(i)) for i, x in enumerate(lists)]
    union = tagged[0]
    for x in tagged[1:]:
        union = union.unionByName(x)
    place = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("source_order", F.desc("score")))
    return union.withColumn("r", place).where("r = 1").drop("r")


def _fused(union: DataFrame, key: str, score: Column, base: tuple[str, ...]) -> DataFrame:
    """Parts added up per query and key; the ``base`` columns are those of the first list that has the key."""
    first = [F.min_by(F.struct(*base), "source_order").alias("base")] if base else []
    return union.groupBy("query_id", key).agg(rounded(score).alias("score"), *first).select("query_id", key, "score", *[f"base.{c}" for c in base])


def reciprocal_ranks(lists: list[tuple[DataFrame, float]], key: str, k: int = RRF_K, normalise: bool = True, base: tuple[str, ...] = ()) -> DataFrame:
    """Weighted reciprocal-rank fusion of (query_id, key, score) lists, by one union and one aggregation.

    A list that lacks the key adds nothing. ``normalise`` divides by the best that could be reached. The ``base`` columns
    come from the first list that has the key.
    """
    if not lists or sum(w for _, w in lists) <= 0:
        raise ValueError("at least one list needs a positive weight")
    parts = [x.select("query_id", key, *base, (F.lit(float(w)) / (k + rank_in_query(key))).alias("part"), F.lit(i).alias("source_order")) for i, (x, w) in enumerate(lists) if w > 0]
    union = parts[0]
    for x in parts[1:]:
        union = union.unionByName(x)
    top = sum(w for _, w in lists) / (k + 1) if normalise else 1.0
    return _fused(union, key, F.sum("part") / top, base)


def combine(title: DataFrame, content: DataFrame, title_weight: float, content_weight: float, top_k: int, base: tuple[str, ...] = ()) -> DataFrame:
    """Weighted mean of title and content scores; a missing side counts as 0, the ``base`` columns are the content row's if there is one."""
    total = title_weight + content_weight
    side = lambda x, w, order: x.select("query_id", "file_path", *base, (F.col("score") * (w / total)).alias("part"), F.lit(order).alias("source_order"))
    union = side(content, content_weight, 0).unionByName(side(title, title_weight, 1))
    return top_per_query(_fused(union, "file_path", F.sum("part"), base), top_k, "file_path")


def min_max(scored: DataFrame) -> DataFrame:
    """Scores of a query to [0, 1]; 1 where all are equal."""
    w = Window.partitionBy("query_id")
    low, span = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    return scored.withColumn("score", rounded(F.when(span == 0, 1.0).otherwise((F.col("score") - low) / span)))


def split_limit(limit: int, embedding_weight: float, bm25_weight: float, up: bool = False) -> tuple[int, int]:
    """Share a retrieval limit between two sources by weight, rounding half up, or both up."""
    total = embedding_weight + bm25_weight
    if total <= 0:
        raise ValueError("at least one weight must be positive")
    # A tenth of a millionth off, so that a whole share stays whole.
    return tuple(ceil(limit * w / total - 1e-7) if up else int(limit * w / total + 0.5) for w in (embedding_weight, bm25_weight))
