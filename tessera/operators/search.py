"""Search over notes: lexical, dense and hybrid, for batches of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import SearchOptions
from tessera.functions import text as T
from tessera.operators import bm25, filters, ranking, vector


def _scope(o: SearchOptions):
    return filters.scope(F.col("file_path"), o.folder, o.exclude_folder, o.exclude_file)


def lexical(entries: bm25.Index | DataFrame, queries: DataFrame, o: SearchOptions, titles: bool = False) -> DataFrame:
    """Scored chunks (query_id, chunk_id, file_path, score, rank); titles have no limit, contents ``o.limit``."""
    scoped = _scope(o) if o.folder or o.exclude_folder or o.exclude_file else None
    scored = bm25.score(entries, queries, scoped, None if titles else o.limit, titles).drop("is_title")
    return scored.withColumn("rank", ranking.rank_in_query("chunk_id"))


def dense(vectors: DataFrame, queries: DataFrame, o: SearchOptions) -> DataFrame:
    """Scored chunks of (chunk_id, file_path, embedding) for (query_id, embedding); the filter runs before scoring."""
    rows = vectors.where(_scope(o)).select(F.struct("chunk_id", "file_path").alias("k"), "embedding")
    found = vector.search(rows.select(F.concat_ws("\u0001", "k.chunk_id", "k.file_path").alias("id"), "embedding"), queries, o.limit)
    part = F.split("id", "\u0001")
    return found.select("query_id", part[0].alias("chunk_id"), part[1].alias("file_path"), "score", "rank")


#: What a result tells beside its score: its best chunk and how many were found.
BASE = ("top_chunk", "chunk_count")


def content(entries: bm25.Index | DataFrame, vectors: DataFrame, queries: DataFrame, o: SearchOptions, base: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, file_path, score): fused file ranks, or the raw scores of the only source with a weight; ``base`` columns of the dense row if there is one."""
    lists = []
    if o.embedding_weight > 0:
        lists.append((ranking.aggregate_files(dense(vectors, queries, o), o.vector_method), o.embedding_weight))
    if o.bm25_weight > 0:
        lists.append((ranking.aggregate_files(lexical(entries, queries, o), o.bm25_method), o.bm25_weight))
    return lists[0][0].select("query_id", "file_path", "score", *base) if len(lists) == 1 else ranking.reciprocal_ranks(lists, "file_path", base=base)


def title(entries: bm25.Index | DataFrame, title_vectors: DataFrame, queries: DataFrame, o: SearchOptions, base: tuple[str, ...] = ()) -> DataFrame:
    lists = []
    if o.embedding_weight > 0:
        asked = queries.withColumn("embedding", F.col("title_embedding")) if "title_embedding" in queries.columns else queries
        lists.append((ranking.aggregate_files(dense(title_vectors, asked, o), "max_p"), o.embedding_weight))
    if o.bm25_weight > 0:
        lists.append((ranking.aggregate_files(lexical(entries, queries, o, titles=True), "max_p"), o.bm25_weight))
    return lists[0][0].select("query_id", "file_path", "score", *base) if len(lists) == 1 else ranking.reciprocal_ranks(lists, "file_path", base=base)


def search(entries: bm25.Index | DataFrame, vectors: DataFrame, title_vectors: DataFrame, queries: DataFrame, o: SearchOptions, base: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, file_path, score, rank): title and content branches combined by weight, the best ``o.top_k``; ``base`` columns (of ``BASE``) on request.

    ``queries`` has (query_id, text, embedding); ``vectors`` and ``title_vectors`` (chunk_id, file_path, embedding). Where titles have a model of their own,
    ``queries`` also has title_embedding.
    """
    if o.title_weight > 0 and o.content_weight > 0:
        return ranking.combine(title(entries, title_vectors, queries, o, base), content(entries, vectors, queries, o, base), o.title_weight, o.content_weight, o.top_k, base)
    only = title(entries, title_vectors, queries, o, base=base) if o.title_weight > 0 else content(entries, vectors, queries, o, base=base)
    return ranking.top_per_query(only.withColumn("score", ranking.rounded(F.col("score"))), o.top_k, "file_path")


def detailed(results: DataFrame, notes: DataFrame, most: int) -> DataFrame:
    """Results with the title and size of their files; ``most`` bounds the number of results, few of which are sent to the notes."""
    return notes.select("file_path", "title", "size").join(bm25.few(results, most), "file_path").select(*results.columns, "title", "size")


def overlap_score(query: DataFrame, candidates: DataFrame) -> DataFrame:
    """A deterministic stand-in for a cross-encoder: the share of distinct query tokens that the chunk holds.

    ``query`` has (query_id, tokens), ``candidates`` (query_id, chunk_id, file_path, tokens).
    """
    q = query.select("query_id", F.array_distinct("tokens").alias("asked"))
    share = F.size(F.array_intersect("asked", "tokens")) / F.greatest(F.size("asked"), F.lit(1))
    return candidates.join(q, "query_id").select("query_id", "chunk_id", "file_path", ranking.rounded(share).alias("score"))


def with_texts(entries: bm25.Index | DataFrame, chunks: DataFrame, most: int, titles: bool = False) -> DataFrame:
    """Path and tokens of the named chunks, after their titles' if asked; ``most`` bounds their number, and few of them are sent to the stored chunks."""
    held = entries.chunks if isinstance(entries, bm25.Index) else entries
    tokens = F.concat(T.tokens(F.coalesce("title", F.lit(""))), "tokens") if titles else F.col("tokens")
    return held.select("chunk_id", "file_path", tokens.alias("tokens")).join(bm25.few(chunks, most), "chunk_id")


def candidates(entries: bm25.Index | DataFrame, vectors: DataFrame, queries: DataFrame, o: SearchOptions, limit: int, up: bool = False) -> DataFrame:
    """(query_id, chunk_id): chunks of both sources, each with its share of the limit, merged."""
    dense_n, lexical_n = ranking.split_limit(limit, o.embedding_weight, o.bm25_weight, up)
    lists = []
    if dense_n:
        lists.append(dense(vectors, queries, o).where(F.col("rank") <= dense_n).select("query_id", "chunk_id", "file_path", "score"))
    if lexical_n:
        lists.append(lexical(entries, queries, o).where(F.col("rank") <= lexical_n).select("query_id", "chunk_id", "file_path", "score"))
    return ranking.merge_first(*lists).select("query_id", "chunk_id")


def rerank_chunks(entries: bm25.Index | DataFrame, vectors: DataFrame, queries: DataFrame, o: SearchOptions, limit: int, scorer=overlap_score, up: bool = False) -> DataFrame:
    """The candidates scored again by ``scorer`` on their titles and texts; queries are cut to what the model's context leaves beside these."""
    asked = queries.select("query_id", T.tokens(F.col("text")).alias("tokens"))
    texts = with_texts(entries, candidates(entries, vectors, queries, o, limit, up), queries.count() * (limit + 1), titles=True)
    return scorer(fitted(asked, texts, o.rerank_context), texts)


#: Tokens of a reranker's context that belong to neither query nor document.
MARGIN = 32


def fitted(asked: DataFrame, texts: DataFrame, context: int) -> DataFrame:
    """Queries (query_id, tokens) cut to the tokens that a context leaves beside the longest of their candidates (query_id, tokens); where none are left they stay whole."""
    longest = texts.groupBy("query_id").agg(F.max(F.size("tokens")).alias("longest"))
    room = F.lit(context - MARGIN) - F.coalesce("longest", F.lit(0))
    cut = F.when(room > 0, F.slice("tokens", F.lit(1), F.greatest(room, F.lit(1)))).otherwise(F.col("tokens"))
    return asked.join(longest, "query_id", "left").select("query_id", cut.alias("tokens"))
