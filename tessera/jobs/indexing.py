"""Index sync from the first build to the next one: differences, deletions, chunks, vectors, postings, failed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.jobs import maintenance as M
from tessera.jobs import retrieval as R
from tessera.operators import bm25, models, sync
from tessera.operators.segments import Store
from tessera.sources import corpus
from tessera.sources.scratch import scratch


def _synced(spark, sf_dir) -> Store:
    """The index after a first sync of the notes as they were and a second one of the notes now."""
    now, old, failed = M._versions(spark, sf_dir)
    notes = corpus.files(spark, sf_dir).select("doc_id", "file_path", "title", "content")
    before = F.when(F.col("doc_id") % 3 == 0, F.expr("left(content, char_length(content) - 1)")).otherwise(F.col("content"))
    was = notes.withColumn("content", before).withColumn("title", T.truncate_words(F.coalesce("content", F.lit("")), 5))
    embed = lambda rows: models.embed(rows, "text")
    index, none = Store(spark, scratch(spark, "index")), old.limit(0)
    index.sync(sync.diff(old, none, none), was.join(old, "file_path"), none, corpus.index_entries, embed)
    index.sync(sync.diff(now, old, failed), notes.join(now, "file_path"), failed, corpus.index_entries, embed)
    return index


def q18_index_sync(spark, sf_dir) -> DataFrame:
    """What each file has in the index after a sync: chunks and their tokens, postings, vectors."""
    store = _synced(spark, sf_dir)
    index = store.snapshot()
    chunks = index.chunks.groupBy("file_path").agg(F.count(F.when(~F.col("is_title"), 1)).alias("chunks"), F.sum("dl").alias("tokens"))
    postings = index.postings.groupBy("file_path").agg(F.count("*").alias("postings"), F.sum("tf").alias("occurrences"))
    each = store.vectors().groupBy("file_path").agg(F.count("*").alias("vectors"), F.round(F.max(F.col("embedding")[0]), 6).alias("a_share"))
    return chunks.join(postings, "file_path", "full").join(each, "file_path", "full")


def q18_synced_terms(spark, sf_dir) -> DataFrame:
    """Document frequencies after a sync, as an index built anew would have them."""
    return _synced(spark, sf_dir).snapshot().terms.select("token", "df")


def q18_merged_index(spark, sf_dir) -> DataFrame:
    """The best chunks of each query after a sync whose segments were merged: as of an index built anew from the notes that it holds."""
    store = _synced(spark, sf_dir)
    store.merge(store.manifest().segments)
    return bm25.score(store.snapshot(), corpus.queries(spark, sf_dir), limit=10, titles=False).select("query_id", "chunk_id", "score")


def snk6_failed_files(spark, sf_dir) -> DataFrame:
    """Files that are on record as failed after a sync."""
    return _synced(spark, sf_dir).failed()


QUERIES = {f.__name__: f for f in (q18_index_sync, q18_synced_terms, q18_merged_index, snk6_failed_files)}

# The notes that the index holds after a sync, cut and counted anew from their texts; a file with a text without letters has no rows.
_CUT = R.ENTRIES[len(R.FILES) :].replace("FROM files)", "FROM kept)").replace("FROM files WHERE", "FROM kept WHERE")
_INDEX = rf"""{M._DIFF},
    held AS (
        SELECT f.file_path, op, CASE WHEN op NOT IN ('create', 'modify') AND doc_id % 3 = 0 THEN left(content, length(content) - 1) ELSE content END AS content
        FROM ops JOIN files f USING (file_path) WHERE op IN ('create', 'modify') OR (op IN ('skip', 'failed') AND doc_id % 7 <> 0)),
    kept AS (SELECT *, array_to_string(list_slice(regexp_extract_all(coalesce(content, ''), '\S+'), 1, 5), ' ') AS title FROM held){_CUT},
    shares AS (SELECT file_path, list_extract({R.LETTERS}, 1) AS a FROM (SELECT file_path, array_to_string(tokens, ' ') AS text FROM entries)),
    bad AS (SELECT DISTINCT file_path FROM shares WHERE a IS NULL),
    good AS (SELECT * FROM entries WHERE file_path NOT IN (SELECT file_path FROM bad)),
    each_token AS (SELECT file_path, chunk_id, unnest(tokens) AS token FROM good)"""

ORACLES = {
    "q18_index_sync": f"""{_INDEX} SELECT file_path, c.chunks, c.tokens, p.postings, p.occurrences, v.vectors, v.a_share
        FROM (SELECT file_path, count(*) FILTER (NOT is_title) AS chunks, sum(dl)::BIGINT AS tokens FROM good GROUP BY 1) c
        FULL JOIN (SELECT file_path, count(DISTINCT (chunk_id, token)) AS postings, count(*) AS occurrences FROM each_token GROUP BY 1) p USING (file_path)
        FULL JOIN (SELECT file_path, count(*) AS vectors, round(max(a), 6) AS a_share FROM shares WHERE file_path NOT IN (SELECT file_path FROM bad) GROUP BY 1) v USING (file_path)""",
    "q18_synced_terms": f"{_INDEX} SELECT token, count(DISTINCT chunk_id) AS df FROM each_token GROUP BY token",
    "q18_merged_index": f"""{_INDEX},
        qterms AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), {R.WORDS})) AS token FROM benchmark) GROUP BY ALL),
        tf AS (SELECT chunk_id, token, count(*) AS tf FROM each_token GROUP BY ALL),
        df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
        whole AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM good),
        scored AS (
            SELECT query_id, chunk_id, round(sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * {bm25.K1 + 1}::DOUBLE
                     / (tf + {bm25.K1}::DOUBLE * ({1 - bm25.B}::DOUBLE + {bm25.B}::DOUBLE * len(tokens) / avgdl))), 6) AS score
            FROM qterms JOIN tf USING (token) JOIN df USING (token) JOIN good USING (chunk_id), whole WHERE NOT is_title GROUP BY ALL)
        SELECT query_id, chunk_id, score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10""",
    "snk6_failed_files": f"""{_INDEX} SELECT file_path, failed.mtime, failed.size::BIGINT AS size FROM failed JOIN ops USING (file_path) WHERE op = 'failed'
        UNION ALL SELECT file_path, now.mtime, now.size::BIGINT FROM bad JOIN kept USING (file_path) JOIN now USING (file_path) WHERE op IN ('create', 'modify')""",
}
