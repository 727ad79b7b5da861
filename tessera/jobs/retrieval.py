"""Indexing and search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import SearchOptions
from tessera.functions import text as T
from tessera.operators import bm25, filters, models, ranking, search, vector
from tessera.sources import corpus, store

# ---- shared SQL of the oracles -------------------------------------------------

WORDS = r"'[\p{L}\p{N}]+'"
FILES = r"""
    files AS (
        SELECT doc_id, source || '/' || doc_id::VARCHAR || '.md' AS file_path,
               array_to_string(list_slice(regexp_extract_all(coalesce(text, ''), '\S+'), 1, 5), ' ') AS title,
               text AS content, n_chars AS size, lang, source
        FROM documents)"""
CHUNKS = FILES + rf""",
    toks AS (SELECT file_path, title, regexp_extract_all(lower(coalesce(content, '')), {WORDS}) AS toks FROM files),
    starts AS (
        SELECT file_path, title, toks, unnest(range(greatest(1, ceil((len(toks) - {corpus.OVERLAP}) / {float(corpus.CHUNK - corpus.OVERLAP)!r}::DOUBLE)::BIGINT))) AS idx
        FROM toks WHERE len(toks) > 0),
    chunks AS (
        SELECT file_path || '#' || idx::VARCHAR AS chunk_id, file_path, title, idx::INTEGER AS chunk_index,
               list_slice(toks, idx * {corpus.CHUNK - corpus.OVERLAP} + 1, idx * {corpus.CHUNK - corpus.OVERLAP} + {corpus.CHUNK}) AS tokens
        FROM starts)"""
ENTRIES = CHUNKS + rf""",
    entries AS (
        SELECT chunk_id, file_path, false AS is_title, tokens, len(tokens)::INTEGER AS dl FROM chunks
        UNION ALL
        SELECT file_path || '#title', file_path, true, regexp_extract_all(lower(title), {WORDS}), len(regexp_extract_all(lower(title), {WORDS}))::INTEGER
        FROM files WHERE len(regexp_extract_all(lower(title), {WORDS})) > 0)"""
BM25 = ENTRIES + rf""",
    queries AS (SELECT item_id AS query_id, text FROM benchmark),
    qterms AS (
        SELECT query_id, token, count(*) AS qtf
        FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), {WORDS})) AS token FROM queries) GROUP BY query_id, token),
    stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM entries),
    post AS (
        SELECT token, chunk_id, file_path, is_title, dl, count(*) AS tf
        FROM (SELECT chunk_id, file_path, is_title, dl, unnest(tokens) AS token FROM entries)
        WHERE token IN (SELECT token FROM qterms) GROUP BY ALL),
    dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token),
    scored AS (
        SELECT query_id, chunk_id, file_path, is_title,
               round(sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * {bm25.K1 + 1}::DOUBLE
                     / (tf + {bm25.K1}::DOUBLE * ({1 - bm25.B}::DOUBLE + {bm25.B}::DOUBLE * dl / avgdl))), 6) AS score
        FROM post JOIN qterms USING (token) JOIN dfs USING (token) CROSS JOIN stats GROUP BY query_id, chunk_id, file_path, is_title)"""
#: A vector of a note is the one with its number; a query has the vector of its own number.
VECTORS = """,
    vecs AS (SELECT f.file_path || '#0' AS chunk_id, f.file_path, e.embedding::DOUBLE[] AS v FROM files f JOIN embeddings e ON e.vec_id = f.doc_id),
    qvecs AS (SELECT b.item_id AS query_id, e.embedding::DOUBLE[] AS v FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
    cosines AS (SELECT query_id, chunk_id, file_path, round(list_cosine_similarity(qvecs.v, vecs.v), 6) AS score FROM qvecs CROSS JOIN vecs)"""


def _top(source: str, limit: int, key: str, columns: str) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM {source}) WHERE rank <= {limit}"


def _files(source: str, method: str) -> str:
    """Scores of files from ranked chunks, as SQL."""
    value = {
        "max_p": "max(score)",
        "top_m_sum": "sum(score) FILTER (r <= 3)",
        "top_m_avg": "sum(score) FILTER (r <= 3) / least(count(*), 3)",
        "rrf_per_doc": "sum(1::DOUBLE / (60 + r))",
        "weighted_top_l_sum": "sum(pow(0.95::DOUBLE, r - 1) * score) FILTER (r <= 3)",
    }[method]
    return f"""(SELECT query_id, file_path, round({value}, {ranking.FILE_DIGITS.get(method, 9)}) AS score, arg_min(chunk_id, r) AS top_chunk, count(*) AS chunk_count
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, chunk_id) AS r FROM {source}) GROUP BY query_id, file_path)"""


def _rrf(lists: list[tuple[str, float]]) -> str:
    top = sum(w for _, w in lists) / 61
    parts = " UNION ALL ".join(
        f"SELECT query_id, file_path, {float(w)!r}::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path)) AS part, top_chunk, chunk_count, {i} AS source_order FROM {x}"
        for i, (x, w) in enumerate(lists)
    )
    return f"(SELECT query_id, file_path, round(sum(part) / {top!r}::DOUBLE, 6) AS score, arg_min(top_chunk, source_order) AS top_chunk, arg_min(chunk_count, source_order) AS chunk_count FROM ({parts}) GROUP BY query_id, file_path)"


def _lexical(limit: int = 100, where: str = "NOT is_title") -> str:
    return f"({_top(f'(SELECT * FROM scored WHERE {where})', limit, 'chunk_id', 'query_id, chunk_id, file_path, score, rank')})"


def _dense(limit: int = 100, where: str = "true") -> str:
    return f"({_top(f'(SELECT * FROM cosines WHERE {where})', limit, 'chunk_id', 'query_id, chunk_id, file_path, score, rank')})"


CONTENT = _rrf([(_files(_dense(), "weighted_top_l_sum"), 0.6), (_files(_lexical(), "max_p"), 0.4)])
#: Shares of letters, as the stand-in for an embedder gives them, of a column ``text`` in lower case; null where there are none.
LETTERS = "list_transform(range(97, 123), lambda c: (length(text) - length(replace(text, chr(c::INTEGER), '')))::DOUBLE / nullif(length(regexp_replace(text, '[^a-z]', '', 'g')), 0))"
#: Titles against queries in the model that embeds titles.
TITLES = f""",
    titles AS (SELECT file_path || '#0' AS chunk_id, file_path, {LETTERS} AS v FROM (SELECT DISTINCT file_path, lower(title) AS text FROM chunks)),
    asked AS (SELECT item_id AS query_id, {LETTERS} AS v FROM (SELECT item_id, lower(text) AS text FROM benchmark)),
    title_cosines AS (SELECT query_id, chunk_id, file_path, round(list_cosine_similarity(asked.v, titles.v), 6) AS score FROM asked CROSS JOIN titles WHERE asked.v[1] IS NOT NULL AND titles.v[1] IS NOT NULL)"""
TITLE = _rrf([(_files(_dense().replace("FROM cosines", "FROM title_cosines"), "max_p"), 0.6), (_files("(SELECT * FROM scored WHERE is_title)", "max_p"), 0.4)])
RESULT = "query_id, file_path, score, rank"


# ---- inputs --------------------------------------------------------------------


def _entries(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """The stored index of the notes; the first search of a session writes it."""
    return store.lexical_index(spark, sf_dir)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = corpus.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    notes = corpus.files(spark, sf_dir).select("doc_id", "file_path")
    return notes.join(v, "doc_id").select(F.concat("file_path", F.lit("#0")).alias("chunk_id"), "file_path", "embedding")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = corpus.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return corpus.queries(spark, sf_dir).join(v, "query_id", "left")


def _embedded(rows: DataFrame) -> DataFrame:
    return models.embed(rows, "text").where("not broken")


def _title_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as their model embeds them; a title leads to its note's first chunk. Broken vectors take no part."""
    first = _entries(spark, sf_dir).chunks.where("chunk_index = 0").select("chunk_id", "file_path", F.lower("title").alias("text"))
    return _embedded(first).select("chunk_id", "file_path", "embedding")


def _asked_of_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedded(corpus.queries(spark, sf_dir).withColumn("text", F.lower("text"))).select("query_id", "embedding")


def _two_model_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark, sf_dir).join(_asked_of_titles(spark, sf_dir).withColumnRenamed("embedding", "title_embedding"), "query_id", "left")


# ---- queries -------------------------------------------------------------------


def fn1_tokens(spark, sf_dir):
    return corpus.files(spark, sf_dir).select("doc_id", T.token_count(F.col("content")).cast("long").alias("n"), F.array_join(F.slice(T.tokens(F.col("content")), 1, 8), " ").alias("head"))


def fn1_mixed_scripts(spark, sf_dir):
    """The words of every title with unspaced sentences before, inside and after it."""
    marked = F.concat(F.lit("東京都に行きました"), F.col("title"), F.lit("カメラと我喜欢吃苹果 x"), F.col("lang"), F.lit("日本"))
    return corpus.files(spark, sf_dir).select("doc_id", F.array_join(T.tokens(marked), "|").alias("words"))


def fn2_distinct_tokens(spark, sf_dir):
    c = F.col("title")
    return corpus.files(spark, sf_dir).select("doc_id", F.size(T.distinct_tokens(F.col("content"))).cast("long").alias("n"), F.array_join(T.bigrams(c), "|").alias("pairs"))


def fn9_token_windows(spark, sf_dir):
    return corpus.chunks(corpus.files(spark, sf_dir)).select("chunk_id", "file_path", "chunk_index", F.array_join("tokens", " ").alias("content"), F.col("dl").cast("long").alias("dl"))


def agg8_postings(spark, sf_dir):
    return _entries(spark, sf_dir).postings.select("token", "chunk_id", "tf")


def agg9_document_frequency(spark, sf_dir):
    return _entries(spark, sf_dir).terms.select("token", "df")


def agg10_index_statistics(spark, sf_dir):
    return _entries(spark, sf_dir).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def q1_bm25_content(spark, sf_dir):
    return search.lexical(_entries(spark, sf_dir), corpus.queries(spark, sf_dir), SearchOptions()).select("query_id", "chunk_id", "file_path", "score", "rank")


def q1_bm25_in_folder(spark, sf_dir):
    o = SearchOptions(folder="src1", exclude_file="src1/1.md")
    return search.lexical(_entries(spark, sf_dir), corpus.queries(spark, sf_dir), o).select("query_id", "chunk_id", "file_path", "score", "rank")


def q2_bm25_title(spark, sf_dir):
    return search.lexical(_entries(spark, sf_dir), corpus.queries(spark, sf_dir), SearchOptions(), titles=True).select("query_id", "chunk_id", "file_path", "score", "rank")


def q3_vector_content(spark, sf_dir):
    q = _queries(spark, sf_dir)
    return search.dense(_vectors(spark, sf_dir), q, SearchOptions()).select("query_id", "chunk_id", "file_path", "score", "rank")


def q3_vector_outside_folder(spark, sf_dir):
    o = SearchOptions(exclude_folder="src2/", top_k=3)
    return search.dense(_vectors(spark, sf_dir), _queries(spark, sf_dir), o).select("query_id", "chunk_id", "file_path", "score", "rank")


def q4_vector_title(spark, sf_dir):
    found = ranking.aggregate_files(search.dense(_vectors(spark, sf_dir), _queries(spark, sf_dir), SearchOptions()), "max_p")
    return found.select("query_id", "file_path", "score", "chunk_count")


def fn3_cosine(spark, sf_dir):
    """The stated queries, ids divisible by 20, against all vectors."""
    v = corpus.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vector.all_cosines(v.where("id % 20 = 0"), v)


def aggregate(method: str):
    def run(spark, sf_dir):
        hits = search.lexical(_entries(spark, sf_dir), corpus.queries(spark, sf_dir), SearchOptions())
        return ranking.aggregate_files(hits, method)

    return run


def q5_hybrid_content(spark, sf_dir):
    return search.content(_entries(spark, sf_dir), _vectors(spark, sf_dir), _queries(spark, sf_dir), SearchOptions())


def q6_hybrid_title(spark, sf_dir):
    return search.title(_entries(spark, sf_dir), _title_vectors(spark, sf_dir), _two_model_queries(spark, sf_dir), SearchOptions())


def q7_hybrid_search(spark, sf_dir):
    o = SearchOptions(title_weight=0.25, content_weight=0.75)
    found = search.search(_entries(spark, sf_dir), _vectors(spark, sf_dir), _title_vectors(spark, sf_dir), _two_model_queries(spark, sf_dir), o)
    return found.select("query_id", "file_path", "score", "rank")


def q8_single_source(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    o = SearchOptions(embedding_weight=0.0, bm25_weight=1.0, top_k=100, multiplier=1)
    return search.search(_entries(spark, sf_dir), v, v, _queries(spark, sf_dir), o).select("query_id", "file_path", "score", "rank")


def win2_weighted_rrf(spark, sf_dir):
    e, q = _entries(spark, sf_dir), _queries(spark, sf_dir)
    lists = [(ranking.aggregate_files(search.dense(_vectors(spark, sf_dir), q, SearchOptions()), "max_p"), 0.8), (ranking.aggregate_files(search.lexical(e, q, SearchOptions()), "max_p"), 0.2)]
    return ranking.reciprocal_ranks(lists, "file_path", normalise=False)


def win5_merge_first(spark, sf_dir):
    e, q = _entries(spark, sf_dir), _queries(spark, sf_dir)
    dense = search.dense(_vectors(spark, sf_dir), q, SearchOptions()).select("query_id", "chunk_id", "score")
    return ranking.merge_first(dense, search.lexical(e, q, SearchOptions()).select("query_id", "chunk_id", "score")).select("query_id", "chunk_id", "score", "source_order")


def agg30_min_max(spark, sf_dir):
    return ranking.min_max(search.lexical(_entries(spark, sf_dir), corpus.queries(spark, sf_dir), SearchOptions())).select("query_id", "chunk_id", "score")


def q10_search_and_rerank(spark, sf_dir):
    scored = search.rerank_chunks(_entries(spark, sf_dir), _vectors(spark, sf_dir), _queries(spark, sf_dir), SearchOptions(), 100)
    return ranking.top_per_query(ranking.min_max(ranking.aggregate_files(scored, "max_p")), 10, "file_path").select("query_id", "file_path", "score", "rank")


def q11_rag_chunks(spark, sf_dir):
    return _rag(spark, sf_dir, SearchOptions()).select("query_id", "chunk_id", "score", "rank")


def _rag(spark, sf_dir, o: SearchOptions, most: int = 5) -> DataFrame:
    """The best chunks of both sources, whose shares of ten times as many are rounded up, after reranking."""
    scored = search.rerank_chunks(_entries(spark, sf_dir), _vectors(spark, sf_dir), _queries(spark, sf_dir), o, most * 10, up=True)
    return ranking.top_per_query(scored, most, "chunk_id")


def q9_file_rerank(spark, sf_dir):
    """The best chunk of each lexical result is scored again."""
    entries, q = _entries(spark, sf_dir), _queries(spark, sf_dir)
    found = ranking.top_per_query(ranking.aggregate_files(search.lexical(entries, q, SearchOptions()), "max_p"), 10, "file_path")
    candidates = search.with_texts(entries, found.select("query_id", F.col("top_chunk").alias("chunk_id")), q.count() * 10)
    asked = search.fitted(q.select("query_id", T.tokens(F.col("text")).alias("tokens")), candidates, SearchOptions().rerank_context)
    scored = search.overlap_score(asked, candidates)
    return ranking.top_per_query(ranking.min_max(scored), 10, "file_path").select("query_id", "file_path", "score", "rank")


def q12_dense_documents(spark, sf_dir):
    """Best cosine per document of any chunk, the first five documents."""
    found = ranking.aggregate_files(search.dense(_vectors(spark, sf_dir), _queries(spark, sf_dir), SearchOptions(top_k=100, multiplier=1)), "max_p")
    return ranking.top_per_query(found.select("query_id", "file_path", "score"), 5, "file_path")


def q13_vault_search(spark, sf_dir):
    """The first five reranked chunks as context blocks, without one folder."""
    top = _rag(spark, sf_dir, SearchOptions(exclude_folder="src3")).select("query_id", "chunk_id", "rank")
    block = T.context_block(F.col("file_path"), F.array(), F.array_join("tokens", " "))
    return search.with_texts(_entries(spark, sf_dir), top, corpus.queries(spark, sf_dir).count() * 5).select("query_id", "chunk_id", "rank", block.alias("block"))


def jon9_result_rows(spark, sf_dir):
    """Results with what a list of them shows: the content branch's best chunk (the dense one first), its number of chunks, title and size."""
    o = SearchOptions(title_weight=1.0, content_weight=3.0)
    q = _two_model_queries(spark, sf_dir)
    found = search.search(_entries(spark, sf_dir), _vectors(spark, sf_dir), _title_vectors(spark, sf_dir), q, o, base=search.BASE)
    return search.detailed(found.select(*RESULT.split(", "), *search.BASE), corpus.files(spark, sf_dir), q.count() * o.top_k)


def q4_embedded_titles(spark, sf_dir):
    """Titles and queries embedded in batches; a title counts as one chunk."""
    found = search.dense(_title_vectors(spark, sf_dir), _asked_of_titles(spark, sf_dir), SearchOptions())
    return found.select("query_id", "chunk_id", "file_path", "score", "rank", F.lit(1).cast("long").alias("chunk_count"))


def udf2_reranked_chunks(spark, sf_dir):
    """Each query's candidates in one call of a reranker, which gives scores and the best five."""
    e, q = _entries(spark, sf_dir), _queries(spark, sf_dir)
    wanted = search.candidates(e, _vectors(spark, sf_dir), q, SearchOptions(), 50, up=True)
    texts = search.with_texts(e, wanted, q.count() * 51, titles=True).select("query_id", "chunk_id", F.array_join("tokens", " ").alias("content"))
    return models.rerank(texts.join(q.select("query_id", F.array_join(T.tokens(F.col("text")), " ").alias("query")), "query_id"), 5)


def snk8_trec_lines(spark, sf_dir):
    found = ranking.top_per_query(ranking.aggregate_files(search.lexical(_entries(spark, sf_dir), corpus.queries(spark, sf_dir), SearchOptions()), "max_p"), 10, "file_path")
    return corpus.run_lines(found.select("query_id", F.col("file_path").alias("doc_id"), "rank", "score"), "bm25")


def src15_trec_round_trip(spark, sf_dir):
    return corpus.parse_run(snk8_trec_lines(spark, sf_dir)).select("query_id", "doc_id", "rank", "score", "run_id")


def tie_filters(spark, sf_dir):
    """Every path predicate on every note."""
    p = F.col("file_path")
    return corpus.files(spark, sf_dir).select(
        "file_path", filters.in_folder(p, "src1").alias("in_src1"), filters.under_root(p, "src1").alias("root_src1"), filters.indexable(p).alias("indexable"),
        filters.excluded(p, "src1*/*5.md").alias("glob"), filters.excluded(p, "src2").alias("component"), filters.excluded(p, "src2/1").alias("prefix"),
        filters.scope(p, exclude_folder="src4", exclude_file="src5/5.md").alias("scoped"),
    )


_METHODS = ["max_p", "top_m_sum", "top_m_avg", "rrf_per_doc", "weighted_top_l_sum"]

QUERIES = {
    f.__name__: f
    for f in (
        fn1_tokens, fn1_mixed_scripts, fn2_distinct_tokens, fn3_cosine, fn9_token_windows, agg8_postings, agg9_document_frequency, agg10_index_statistics,
        q1_bm25_content, q1_bm25_in_folder, q2_bm25_title, q3_vector_content, q3_vector_outside_folder, q4_vector_title, q5_hybrid_content,
        q6_hybrid_title, q7_hybrid_search, q8_single_source, q9_file_rerank, q10_search_and_rerank, q11_rag_chunks, q12_dense_documents,
        q13_vault_search, jon9_result_rows, q4_embedded_titles, udf2_reranked_chunks, win2_weighted_rrf, win5_merge_first, agg30_min_max, snk8_trec_lines,
        src15_trec_round_trip,
    )
} | {f"agg_{m}": aggregate(m) for m in _METHODS} | {"flt_path_predicates": tie_filters}



def _fill(sql: str, *parts: str) -> str:
    """Put the parts where ``{}`` stands; other braces (of patterns) stay."""
    for part in parts:
        sql = sql.replace("{}", part, 1)
    return sql


_MERGED = "(SELECT DISTINCT query_id, chunk_id FROM (SELECT query_id, chunk_id FROM {} UNION ALL SELECT query_id, chunk_id FROM {}))"
#: Candidates against the query's words; ``{}`` stands for the candidates, ``TOKENS`` for what a candidate holds.
_OVERLAP = """(SELECT m.query_id, m.chunk_id, e.file_path,
        round(len(list_intersect(list_distinct(q.tokens), TOKENS)) / greatest(len(list_distinct(q.tokens)), 1)::DOUBLE, 6) AS score
    FROM {} m JOIN entries e USING (chunk_id) JOIN files f ON f.file_path = e.file_path JOIN (SELECT query_id, regexp_extract_all(lower(text), """ + WORDS + """) AS tokens FROM queries) q USING (query_id))"""
_RERANK = _OVERLAP.replace("TOKENS", "e.tokens")
_TITLED = f"list_concat(regexp_extract_all(lower(f.title), {WORDS}), e.tokens)"
_RERANK_TITLED = _OVERLAP.replace("TOKENS", _TITLED)


def _rag_sql(where: str = "true") -> str:
    merged = _fill(_MERGED, _dense(30, where), _lexical(20, f"NOT is_title AND {where}"))
    return _top(_fill(_RERANK_TITLED, merged), 5, "chunk_id", "query_id, chunk_id, score, rank")


_FILES100 = _files(_lexical(), "max_p")
_MINMAX = "(SELECT * EXCLUDE (score), round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS score FROM {} WINDOW w AS (PARTITION BY query_id))"

ORACLES = {
    "fn1_tokens": f"SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), {WORDS}))::BIGINT AS n, array_to_string(list_slice(regexp_extract_all(lower(coalesce(text, '')), {WORDS}), 1, 8), ' ') AS head FROM documents",
    "fn1_mixed_scripts": rf"""WITH {FILES}, w AS (
            SELECT doc_id, regexp_extract_all(regexp_replace(lower('東京都に行きました' || title || 'カメラと我喜欢吃苹果 x' || lang || '日本'), '([\p{{Han}}々〆]+|\p{{Hiragana}}+|[\p{{Katakana}}ー]+)', ' \1 ', 'g'), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*') AS ws FROM files)
        SELECT doc_id, array_to_string(flatten(list_transform(ws, lambda w: CASE WHEN regexp_matches(w, '^[\p{{Han}}々〆]{{3,}}$') THEN list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) ELSE [w] END)), '|') AS words FROM w""",
    "fn2_distinct_tokens": rf"""WITH {FILES},
        f AS (SELECT doc_id, content, regexp_replace(lower(title), '\s+', '', 'g') AS flat FROM files)
        SELECT doc_id, len(list_distinct(regexp_extract_all(lower(coalesce(content, '')), '\S+')))::BIGINT AS n,
               CASE WHEN length(flat) < 2 THEN '' ELSE coalesce((SELECT string_agg(p, '|' ORDER BY first) FROM (SELECT p, min(i) AS first FROM (SELECT i, substr(flat, i, 2) AS p FROM range(1, length(flat)) t(i)) GROUP BY p)), '') END AS pairs
        FROM f""",
    "fn3_cosine": """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
        FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id""",
    "fn9_token_windows": f"WITH {CHUNKS} SELECT chunk_id, file_path, chunk_index, array_to_string(tokens, ' ') AS content, len(tokens)::BIGINT AS dl FROM chunks",
    "agg8_postings": f"WITH {ENTRIES} SELECT token, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS token FROM entries) GROUP BY token, chunk_id",
    "agg9_document_frequency": f"WITH {ENTRIES} SELECT token, count(DISTINCT chunk_id) AS df FROM (SELECT chunk_id, unnest(tokens) AS token FROM entries) GROUP BY token",
    "agg10_index_statistics": f"WITH {ENTRIES} SELECT count(*) AS n, round(avg(dl), 6) AS avgdl FROM entries",
    "q1_bm25_content": f"WITH {BM25} SELECT query_id, chunk_id, file_path, score, rank FROM {_lexical()}",
    "q1_bm25_in_folder": f"WITH {BM25} SELECT query_id, chunk_id, file_path, score, rank FROM {_lexical(where="NOT is_title AND starts_with(file_path, 'src1/') AND file_path <> 'src1/1.md'")}",
    "q2_bm25_title": f"WITH {BM25} SELECT query_id, chunk_id, file_path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE is_title",
    "q3_vector_content": f"WITH {FILES} {VECTORS} SELECT query_id, chunk_id, file_path, score, rank FROM {_dense()}",
    "q3_vector_outside_folder": f"WITH {FILES} {VECTORS} SELECT query_id, chunk_id, file_path, score, rank FROM {_dense(30, "NOT starts_with(file_path, 'src2/')")}",
    "q4_vector_title": f"WITH {FILES} {VECTORS} SELECT query_id, file_path, score, chunk_count FROM {_files(_dense(), 'max_p')}",
    "q5_hybrid_content": f"WITH {BM25} {VECTORS} SELECT query_id, file_path, score FROM {CONTENT}",
    "q6_hybrid_title": f"WITH {BM25} {VECTORS} {TITLES} SELECT query_id, file_path, score FROM {TITLE}",
    "q7_hybrid_search": f"""WITH {BM25} {VECTORS} {TITLES} {_top(f"(SELECT query_id, file_path, round(sum(part), 6) AS score FROM (SELECT query_id, file_path, score * 0.25::DOUBLE AS part FROM {TITLE} UNION ALL SELECT query_id, file_path, score * 0.75::DOUBLE FROM {CONTENT}) GROUP BY query_id, file_path)", 10, "file_path", RESULT)}""",
    "q8_single_source": f"WITH {BM25} {_top(_FILES100, 100, 'file_path', RESULT)}",
    "q9_file_rerank": f"WITH {BM25}, best AS (SELECT query_id, top_chunk AS chunk_id FROM ({_top(_FILES100, 10, 'file_path', 'query_id, top_chunk')})) {_top(_fill(_MINMAX, _fill(_RERANK, 'best')), 10, 'file_path', RESULT)}",
    "q10_search_and_rerank": f"WITH {BM25} {VECTORS} {_top(_fill(_MINMAX, _files(_fill(_RERANK_TITLED, _fill(_MERGED, _dense(60), _lexical(40))), 'max_p')), 10, 'file_path', RESULT)}",
    "q11_rag_chunks": f"WITH {BM25} {VECTORS} {_rag_sql()}",
    "q12_dense_documents": f"WITH {FILES} {VECTORS} {_top(_files(_dense(), 'max_p'), 5, 'file_path', RESULT)}",
    "q13_vault_search": f"WITH {BM25} {VECTORS} SELECT query_id, chunk_id, rank, '[[' || regexp_replace(e.file_path, '\\.md$', '') || ']]' || chr(10) || array_to_string(e.tokens, ' ') AS block FROM ({_rag_sql("NOT starts_with(file_path, 'src3/')")}) t JOIN entries e USING (chunk_id)",
    "jon9_result_rows": f"""WITH {BM25} {VECTORS} {TITLES} SELECT {RESULT}, top_chunk, chunk_count, title, size FROM ({_top(f"(SELECT query_id, file_path, round(sum(part), 6) AS score, arg_min(top_chunk, o) AS top_chunk, arg_min(chunk_count, o) AS chunk_count FROM (SELECT query_id, file_path, score * 0.25::DOUBLE AS part, top_chunk, chunk_count, 1 AS o FROM {TITLE} UNION ALL SELECT query_id, file_path, score * 0.75::DOUBLE, top_chunk, chunk_count, 0 FROM {CONTENT}) GROUP BY query_id, file_path)", 10, "file_path", RESULT + ", top_chunk, chunk_count")}) JOIN files USING (file_path)""",
    "q4_embedded_titles": f"WITH {ENTRIES} {TITLES} SELECT query_id, chunk_id, file_path, score, rank, 1::BIGINT AS chunk_count FROM {_dense().replace('FROM cosines', 'FROM title_cosines')}",
    "udf2_reranked_chunks": f"WITH {BM25} {VECTORS} SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM ({_rag_sql()})",
    "win2_weighted_rrf": f"WITH {BM25} {VECTORS} SELECT query_id, file_path, round(score, 6) AS score FROM {_rrf([(_files(_dense(), 'max_p'), 0.8), (_FILES100, 0.2)]).replace(f'/ {1 / 61!r}::DOUBLE', '')}",
    "win5_merge_first": f"""WITH {BM25} {VECTORS} SELECT query_id, chunk_id, score, source_order FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY source_order) AS r FROM (
            SELECT query_id, chunk_id, score, 0 AS source_order FROM {_dense()} UNION ALL SELECT query_id, chunk_id, score, 1 FROM {_lexical()})) WHERE r = 1""",
    "agg30_min_max": f"WITH {BM25} SELECT query_id, chunk_id, score FROM {_fill(_MINMAX, _lexical())}",
    "snk8_trec_lines": f"WITH {BM25} SELECT query_id::VARCHAR || ' Q0 ' || file_path || ' ' || rank::VARCHAR || ' ' || printf('%.6f', score) || ' bm25' AS value FROM ({_top(_FILES100, 10, 'file_path', RESULT)})",
    "src15_trec_round_trip": f"WITH {BM25} SELECT query_id::VARCHAR AS query_id, file_path AS doc_id, rank::INTEGER AS rank, score, 'bm25' AS run_id FROM ({_top(_FILES100, 10, 'file_path', RESULT)})",
    "flt_path_predicates": rf"""WITH {FILES} SELECT file_path, starts_with(file_path, 'src1/') AS in_src1, starts_with(file_path, 'src1') AS root_src1, true AS indexable,
        regexp_matches(file_path, '^src1.*/.*5\.md$') AS glob, starts_with(file_path, 'src2/') AS component, starts_with(file_path, 'src2/1') AS prefix,
        NOT starts_with(file_path, 'src4/') AND file_path <> 'src5/5.md' AS scoped FROM files""",
} | {f"agg_{m}": f"WITH {BM25} SELECT query_id, file_path, score, top_chunk, chunk_count FROM {_files(_lexical(), m)}" for m in _METHODS}
