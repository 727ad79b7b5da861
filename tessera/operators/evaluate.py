"""Retrieval metrics and roll-ups of graded answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6


def per_query(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, ndcg10, recall10, recall100, rr10, ap) for every query with a relevant document.

    ``run`` has (query_id, doc_id, rank); ``qrels`` (query_id, doc_id, relevance). Gains are linear; what is not
    judged counts 0, and a judged query without results counts 0 throughout.
    """
    good = qrels.where("relevance > 0")
    ideal = good.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id")))
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("i") <= 10, F.col("relevance") / F.log2(F.col("i") + 1))).alias("idcg"))
    hits = run.join(good, ["query_id", "doc_id"]).withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    top = F.col("rank") <= 10
    scored = hits.groupBy("query_id").agg(
        F.sum(F.when(top, F.col("relevance") / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.count(F.when(top, 1)).alias("hits10"),
        F.count(F.when(F.col("rank") <= 100, 1)).alias("hits100"),
        F.min(F.when(top, F.col("rank"))).alias("first"),
        F.sum(F.col("nth") / F.col("rank")).alias("precisions"),
    )
    share = lambda x, y: F.round(F.coalesce(F.col(x) / F.col(y), F.lit(0.0)), DIGITS)
    return ideal.join(scored, "query_id", "left").select(
        "query_id",
        F.round(F.when(F.col("idcg") > 0, F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0))).otherwise(0.0), DIGITS).alias("ndcg10"),
        share("hits10", "relevant").alias("recall10"),
        share("hits100", "relevant").alias("recall100"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), DIGITS).alias("rr10"),
        share("precisions", "relevant").alias("ap"),
    )


def macro(metrics: DataFrame, *by: str) -> DataFrame:
    """Means over queries."""
    names = {"ndcg10": "ndcg10", "recall10": "recall10", "recall100": "recall100", "rr10": "mrr10", "ap": "map"}
    return metrics.groupBy(*by).agg(F.count("*").alias("queries"), *[F.round(F.avg(a), 5).alias(b) for a, b in names.items()])


def grades(graded: DataFrame, *keys: str) -> DataFrame:
    """Counts and rates of (evaluation, keys...) in one pass: by each key alone, and in total.

    accuracy and hallucination are shares of correct and incorrect, score their difference. A
    blank key is ``unknown``.
    """
    rows = graded.select("evaluation", *[F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit("unknown")).alias(k) for k in keys])
    sets = [*[[F.col(k)] for k in keys], []]
    n = F.count("*")
    of = lambda e: F.count(F.when(F.col("evaluation") == e, 1))
    return rows.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("grouping"), n.alias("total"), of("correct").alias("correct"), of("incorrect").alias("incorrect"), of("missing").alias("missing"),
        F.round(of("correct") / n, DIGITS).alias("accuracy"), F.round(of("incorrect") / n, DIGITS).alias("hallucination"),
        F.round((of("correct") - of("incorrect")) / n, DIGITS).alias("score"),
    )
