"""Metrics of search results and roll-ups of graded answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import SearchOptions
from tessera.functions import text as T
from tessera.jobs import retrieval as R
from tessera.operators import evaluate, prepare, ranking, search
from tessera.sources import corpus


def _qrels(spark, sf_dir):
    """A note is relevant to a passage with which it shares its first token pair run; graded 2 where it holds it whole."""
    words = corpus.files(spark, sf_dir).select("file_path", F.explode(F.array_distinct(T.tokens(F.col("content")))).alias("token"))
    asked = corpus.queries(spark, sf_dir).select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    n = asked.groupBy("query_id").agg(F.count("*").alias("n"))
    shared = asked.join(words, "token").groupBy("query_id", "file_path").agg(F.count("*").alias("k")).join(n, "query_id")
    grade = F.when(F.col("k") == F.col("n"), 2).when(F.col("k") * 10 >= F.col("n") * 6, 1).otherwise(0)
    return shared.select("query_id", F.col("file_path").alias("doc_id"), grade.alias("relevance")).where("relevance > 0")


def _runs(spark, sf_dir):
    """Results of three methods, the method as a column: one job evaluates them all."""
    e, v, q = R._entries(spark, sf_dir), R._vectors(spark, sf_dir), R._queries(spark, sf_dir)
    o = SearchOptions(top_k=100, multiplier=1)
    dense, lexical = (ranking.aggregate_files(x, "max_p").select("query_id", "file_path", "score") for x in (search.dense(v, q, o), search.lexical(e, q, o)))
    plans = {"bm25": lexical, "vector": dense, "hybrid": ranking.reciprocal_ranks([(dense, 0.5), (lexical, 0.5)], "file_path")}
    out = None
    for name, found in plans.items():
        part = ranking.top_per_query(found, 100, "file_path")
        part = part.select(F.lit(name).alias("method"), F.concat_ws(":", F.lit(name), "query_id").alias("query_id"), F.col("file_path").alias("doc_id"), "rank")
        out = part if out is None else out.unionByName(part)
    return out


def agg17_query_metrics(spark, sf_dir):
    run = _runs(spark, sf_dir).where("method = 'bm25'")
    qrels = _qrels(spark, sf_dir).withColumn("query_id", F.concat_ws(":", F.lit("bm25"), "query_id"))
    return evaluate.per_query(run, qrels)


def q16_multi_run_metrics(spark, sf_dir):
    methods = spark.createDataFrame([("bm25",), ("vector",), ("hybrid",)], "method string")
    base = _qrels(spark, sf_dir)
    qrels = base.join(F.broadcast(methods)).select(F.concat_ws(":", "method", "query_id").alias("query_id"), "doc_id", "relevance")
    scored = evaluate.per_query(_runs(spark, sf_dir), qrels)
    return evaluate.macro(scored.withColumn("method", F.split("query_id", ":")[0]), "method")


def _graded(spark, sf_dir):
    """Labels as grades of the answers about documents."""
    labels = corpus.table(spark, sf_dir, "labels")
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "es", "").otherwise(F.col("lang")).alias("lang"), "source")
    grade = F.when(F.col("toxic") == 1, "incorrect").when(F.col("quality") == 1, "correct").otherwise("missing")
    return labels.join(docs, "doc_id").select(grade.alias("evaluation"), F.col("lang").alias("domain"), F.col("source").alias("question_type"))


def agg22_grades(spark, sf_dir):
    return evaluate.grades(_graded(spark, sf_dir), "domain", "question_type").withColumn("grouping", F.col("grouping").cast("long"))


def snk10_compare_runs(spark, sf_dir):
    """Two summaries side by side with the differences as text."""
    rows = _graded(spark, sf_dir)
    a = evaluate.grades(rows.where("domain = 'en'")).select(F.lit(1).alias("k"), F.col("accuracy").alias("a"), F.col("score").alias("sa"))
    b = evaluate.grades(rows.where("domain <> 'en'")).select(F.lit(1).alias("k"), F.col("accuracy").alias("b"), F.col("score").alias("sb"))
    diff = lambda x, y: F.format_string("%+.1f%%", (F.col(y) - F.col(x)) * 100)
    return a.join(b, "k").select("a", "b", diff("a", "b").alias("accuracy_diff"), diff("sa", "sb").alias("score_diff"))


def agg24_distribution(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.round(F.avg("n_chars"), 3).alias("avg_chars"), F.countDistinct("source").alias("sources"))


def agg25_cost(spark, sf_dir):
    """Tokens of each language's texts at a price per million."""
    docs = corpus.table(spark, sf_dir, "documents").select("lang", T.token_count(F.col("text")).cast("long").alias("n"))
    return docs.groupBy("lang").agg(F.sum("n").alias("tokens"), F.round(F.sum("n") * 0.13 / 1_000_000, 9).alias("cost"))


def agg28_vector_diagnostics(spark, sf_dir):
    """Norm, extremes, mean and deviation of each vector, and how it compares with the one before it."""
    from tessera.operators.vector import cosine

    v = corpus.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    flat = v.select("vec_id", F.explode("embedding").alias("x")).groupBy("vec_id").agg(
        F.round(F.sqrt(F.sum(F.col("x").cast("double") * F.col("x"))), 6).alias("norm"), F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high"),
        F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.round(F.stddev_pop(F.col("x").cast("double")), 6).alias("std"),
    )
    before = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("y"))
    c = F.round(cosine(F.col("embedding"), F.col("y")), 6)
    near = v.join(before, "vec_id").select("vec_id", c.alias("cosine"), F.when(c >= 0.99, "same").when(c >= 0.9, "close").otherwise("different").alias("verdict"))
    return flat.join(near, "vec_id", "left")


def q19_subset(spark, sf_dir):
    """A benchmark subset: sampled queries, their relevant notes, and the best lexical hits of each."""
    q = prepare.sample(corpus.queries(spark, sf_dir), "query_id", 20)
    must = _qrels(spark, sf_dir).join(q.select("query_id"), "query_id", "left_semi").select(F.col("doc_id").alias("file_path"))
    hits = ranking.top_per_query(ranking.aggregate_files(search.lexical(R._entries(spark, sf_dir), q, SearchOptions()), "max_p"), 20, "file_path").select("file_path")
    return must.union(hits).distinct()


QUERIES = {f.__name__: f for f in (agg17_query_metrics, q16_multi_run_metrics, agg22_grades, snk10_compare_runs, agg24_distribution, agg25_cost, agg28_vector_diagnostics, q19_subset)}

QRELS = rf""",
    words AS (SELECT DISTINCT file_path, unnest(regexp_extract_all(lower(coalesce(content, '')), {R.WORDS})) AS token FROM files),
    asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), {R.WORDS})) AS token FROM benchmark),
    sizes AS (SELECT query_id, count(*) AS n FROM asked GROUP BY query_id),
    qrels AS (
        SELECT query_id, file_path AS doc_id, CASE WHEN k = n THEN 2 ELSE 1 END AS relevance
        FROM (SELECT query_id, file_path, count(*) AS k FROM asked JOIN words USING (token) GROUP BY query_id, file_path) JOIN sizes USING (query_id)
        WHERE k * 10 >= n * 6)"""
_LEX = R._files(R._lexical(100), "max_p")
_RUN = {"bm25": _LEX, "vector": R._files(R._dense(100), "max_p"), "hybrid": R._rrf([(R._files(R._dense(100), "max_p"), 0.5), (_LEX, 0.5)])}
RUNS = ",\n    runs AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, query_id, file_path AS doc_id, rank FROM ({R._top(x, 100, 'file_path', 'query_id, file_path, rank')})" for m, x in _RUN.items()) + ")"
METRICS = """,
    ideal AS (
        SELECT query_id, count(*) AS relevant, sum(relevance / log2(i + 1)) FILTER (i <= 10) AS idcg
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS i FROM qrels) GROUP BY query_id),
    hits AS (
        SELECT method, query_id, relevance, rank, row_number() OVER (PARTITION BY method, query_id ORDER BY rank) AS nth
        FROM runs JOIN qrels USING (query_id, doc_id)),
    sums AS (
        SELECT method, query_id, sum(relevance / log2(rank + 1)) FILTER (rank <= 10) AS dcg, count(*) FILTER (rank <= 10) AS hits10,
               count(*) FILTER (rank <= 100) AS hits100, min(rank) FILTER (rank <= 10) AS first, sum(nth / rank::DOUBLE) AS precisions
        FROM hits GROUP BY method, query_id),
    metrics AS (
        SELECT m.method, i.query_id, round(coalesce(dcg / idcg, 0), 6) AS ndcg10, round(coalesce(hits10 / relevant::DOUBLE, 0), 6) AS recall10,
               round(coalesce(hits100 / relevant::DOUBLE, 0), 6) AS recall100, round(coalesce(1::DOUBLE / first, 0), 6) AS rr10, round(coalesce(precisions / relevant, 0), 6) AS ap
        FROM ideal i CROSS JOIN (SELECT DISTINCT method FROM runs) m LEFT JOIN sums s ON s.query_id = i.query_id AND s.method = m.method)"""
GRADED = """graded AS (
    SELECT CASE WHEN toxic = 1 THEN 'incorrect' WHEN quality = 1 THEN 'correct' ELSE 'missing' END AS evaluation,
           CASE WHEN lang = 'es' THEN 'unknown' ELSE lang END AS domain, source AS question_type
    FROM labels JOIN documents USING (doc_id))"""
_COUNTS = """count(*) AS total, count(*) FILTER (evaluation = 'correct') AS correct, count(*) FILTER (evaluation = 'incorrect') AS incorrect, count(*) FILTER (evaluation = 'missing') AS missing,
    round(count(*) FILTER (evaluation = 'correct') / count(*)::DOUBLE, 6) AS accuracy, round(count(*) FILTER (evaluation = 'incorrect') / count(*)::DOUBLE, 6) AS hallucination,
    round((count(*) FILTER (evaluation = 'correct') - count(*) FILTER (evaluation = 'incorrect')) / count(*)::DOUBLE, 6) AS score"""

ORACLES = {
    "agg17_query_metrics": f"WITH {R.BM25} {R.VECTORS} {QRELS} {RUNS} {METRICS} SELECT 'bm25:' || query_id::VARCHAR AS query_id, ndcg10, recall10, recall100, rr10, ap FROM metrics WHERE method = 'bm25'",
    "q16_multi_run_metrics": f"""WITH {R.BM25} {R.VECTORS} {QRELS} {RUNS} {METRICS}
        SELECT method, count(*) AS queries, round(avg(ndcg10), 5) AS ndcg10, round(avg(recall10), 5) AS recall10, round(avg(recall100), 5) AS recall100, round(avg(rr10), 5) AS mrr10, round(avg(ap), 5) AS map
        FROM metrics GROUP BY method""",
    "agg22_grades": f"""WITH {GRADED}
        SELECT domain, NULL AS question_type, 1::BIGINT AS grouping, {_COUNTS} FROM graded GROUP BY domain
        UNION ALL SELECT NULL, question_type, 2, {_COUNTS} FROM graded GROUP BY question_type
        UNION ALL SELECT NULL, NULL, 3, {_COUNTS} FROM graded""",
    "snk10_compare_runs": f"""WITH {GRADED},
        a AS (SELECT {_COUNTS} FROM graded WHERE domain = 'en'), b AS (SELECT {_COUNTS} FROM graded WHERE domain <> 'en')
        SELECT a.accuracy AS a, b.accuracy AS b, printf('%+.1f%%', (b.accuracy - a.accuracy) * 100) AS accuracy_diff, printf('%+.1f%%', (b.score - a.score) * 100) AS score_diff FROM a CROSS JOIN b""",
    "agg24_distribution": "SELECT lang, count(*) AS docs, round(avg(n_chars), 3) AS avg_chars, count(DISTINCT source) AS sources FROM documents GROUP BY lang",
    "agg25_cost": f"SELECT lang, sum(n)::BIGINT AS tokens, round(sum(n) * 0.13::DOUBLE / 1000000, 9) AS cost FROM (SELECT lang, len(regexp_extract_all(lower(coalesce(text, '')), {R.WORDS})) AS n FROM documents) GROUP BY lang",
    "agg28_vector_diagnostics": """WITH flat AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings),
        f AS (SELECT vec_id, round(sqrt(sum(x::DOUBLE * x::DOUBLE)), 6) AS norm, min(x)::DOUBLE AS low, max(x)::DOUBLE AS high, round(avg(x::DOUBLE), 6) AS mean, round(stddev_pop(x::DOUBLE), 6) AS std FROM flat GROUP BY vec_id),
        c AS (SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1)
        SELECT f.*, cosine, CASE WHEN cosine >= 0.99 THEN 'same' WHEN cosine >= 0.9 THEN 'close' WHEN cosine IS NOT NULL THEN 'different' END AS verdict FROM f LEFT JOIN c USING (vec_id)""",
    "q19_subset": f"""WITH {R.BM25} {QRELS},
        picked AS (SELECT item_id AS query_id FROM benchmark ORDER BY md5('42:' || item_id::VARCHAR), item_id LIMIT 20)
        SELECT DISTINCT file_path FROM (
            SELECT doc_id AS file_path FROM qrels WHERE query_id IN (SELECT query_id FROM picked)
            UNION ALL SELECT file_path FROM ({R._top(_LEX, 20, 'file_path', 'query_id, file_path')}) WHERE query_id IN (SELECT query_id FROM picked))""",
}
