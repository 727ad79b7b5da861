"""Index maintenance: differences, upserts, coalesced changes, failed files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.jobs import retrieval as R
from tessera.operators import prepare, sync
from tessera.operators.segments import Store
from tessera.sources import corpus, store
from tessera.sources.runs import RunLog
from tessera.sources.scratch import scratch

# What the kinds of events stand for.
OPS = {"signup": "create", "view": "modify", "click": "modify", "error": "delete", "purchase": "rename"}


def _versions(spark, sf_dir):
    """The notes now, as indexed before, and those that failed: every third grew, every seventh is new, and so on."""
    d = corpus.files(spark, sf_dir).select("doc_id", "file_path", (F.col("doc_id") * 1000).alias("mtime"), "size")
    now = d.where("doc_id % 11 <> 0").select("file_path", "mtime", "size")
    old = d.where("doc_id % 7 <> 0").select("file_path", "mtime", F.when(F.col("doc_id") % 3 == 0, F.col("size") - 1).otherwise(F.col("size")).alias("size"))
    failed = d.where("doc_id % 13 = 0").select("file_path", F.when(F.col("doc_id") % 2 == 0, F.col("mtime")).otherwise(F.col("mtime") + 1).alias("mtime"), "size")
    return now, old, failed


def jon10_sync_diff(spark, sf_dir):
    return sync.diff(*_versions(spark, sf_dir))


def agg16_sync_counts(spark, sf_dir):
    return jon10_sync_diff(spark, sf_dir).groupBy("op").agg(F.count("*").alias("n"))


def stm2_coalesced_changes(spark, sf_dir):
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in OPS.items()])
    changes = corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), kind.alias("op"))
    return sync.coalesced(changes)


def stm4_latest_request(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events").select(F.col("event_type").alias("component"), "ts", F.col("event_id").alias("request"))
    return sync.latest(e)


def stm5_renames(spark, sf_dir):
    d = corpus.files(spark, sf_dir).select("doc_id", "file_path")
    to = F.concat(F.lit("moved/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, ".txt").otherwise(".md"))
    return sync.renames(d.select(F.col("file_path").alias("old_path"), to.alias("new_path")), d.where("doc_id % 3 <> 0"))


def _changed(spark, sf_dir):
    notes = corpus.files(spark, sf_dir)
    edited = notes.where("doc_id % 10 = 0").withColumn("content", F.concat("content", F.lit(" edited edited")))
    return notes, edited


def _branch(spark, sf_dir, gone, notes, op: str) -> Store:
    """The stored index of the notes with one more segment: ``gone`` (file_path) are taken out, ``notes`` put in."""
    index = store.lexical_store(spark, sf_dir).branch(scratch(spark, "index"))
    index.sync(gone.select("file_path", F.lit(op).alias("op")), notes.withColumns({"mtime": F.lit(0).cast("long"), "size": F.col("size").cast("long")}), None, corpus.index_entries)
    return index


def snk3_incremental_postings(spark, sf_dir):
    """Counts of tokens after some notes changed: a segment for these beside the stored ones, which stay as they are."""
    _, edited = _changed(spark, sf_dir)
    return _branch(spark, sf_dir, edited, edited, "modify").snapshot().terms.select("token", F.col("cf").alias("tf"), "df")


def snk1_upserted_chunks(spark, sf_dir):
    notes, edited = _changed(spark, sf_dir)
    pick = lambda x: corpus.chunks(x).select("chunk_id", "file_path", F.col("dl").cast("long").alias("dl"))
    after = sync.remove(pick(notes), edited, "file_path").unionByName(pick(edited))
    return after.groupBy("file_path").agg(F.count("*").alias("chunks"), F.sum("dl").alias("tokens"))


def snk4_deleted_postings(spark, sf_dir):
    """Document frequencies after some notes went; tokens without postings are gone too."""
    notes = corpus.files(spark, sf_dir)
    return _branch(spark, sf_dir, notes.where("doc_id % 5 = 0"), notes.limit(0), "delete").snapshot().terms.select("token", "df")


def snk2_upserted_vectors(spark, sf_dir):
    v = corpus.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    new = v.where("vec_id % 9 = 0").select((F.col("vec_id") + 3).alias("vec_id"), F.transform("embedding", lambda x: -x).alias("embedding"))
    after = sync.upsert(v, new, "vec_id")
    return after.select("vec_id", F.round(F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def flt10_failed_vectors(spark, sf_dir):
    """Files with a NaN vector are rejected whole; every 50th vector is broken here."""
    v = corpus.table(spark, sf_dir, "embeddings")
    broken = F.when(F.col("vec_id") % 50 == 0, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))
    return sync.quarantine(v.select(F.concat(F.lit("g"), (F.col("vec_id") % 40).cast("string")).alias("file_path"), broken.alias("embedding")))


def agg12_index_stats(spark, sf_dir):
    return corpus.chunks(corpus.files(spark, sf_dir)).agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"))


def agg13_corpus_stats(spark, sf_dir):
    c = corpus.files(spark, sf_dir).select(F.col("size").alias("chars"), F.octet_length("content").cast("long").alias("bytes"))
    return prepare.length_statistics(c, "chars", "bytes")


def agg15_first_chunk(spark, sf_dir):
    c = corpus.chunks(corpus.files(spark, sf_dir))
    return c.groupBy("file_path").agg(F.min_by(F.array_join("tokens", " "), F.col("chunk_index")).alias("content"), F.count("*").alias("chunks"))


def jon14_resume(spark, sf_dir):
    """Queries that a stopped run has not answered yet."""
    q = corpus.queries(spark, sf_dir)
    return q.join(q.where("query_id % 3 = 0").select("query_id"), "query_id", "left_anti")


def snk9_resumed_run(spark, sf_dir):
    """Answers of a run that was stopped after a third of its queries, started again over half of them, and again over all: one of each."""
    q = corpus.queries(spark, sf_dir).select("query_id", F.char_length("text").cast("long").alias("answer"))
    log = RunLog(spark, scratch(spark, "run"), "query_id long, answer long", "query_id")
    for done in (F.col("query_id") % 3 == 0, F.col("query_id") % 2 == 0, F.lit(True)):
        log.append(log.pending(q.where(done)))
    return log.read()


QUERIES = {
    f.__name__: f
    for f in (
        jon10_sync_diff, agg16_sync_counts, stm2_coalesced_changes, stm4_latest_request, stm5_renames, snk1_upserted_chunks, snk2_upserted_vectors,
        snk3_incremental_postings, snk4_deleted_postings, flt10_failed_vectors, agg12_index_stats, agg13_corpus_stats, agg15_first_chunk, jon14_resume, snk9_resumed_run,
    )
}

_DIFF = f"""WITH {R.FILES},
    now AS (SELECT file_path, doc_id * 1000 AS mtime, size FROM files WHERE doc_id % 11 <> 0),
    old AS (SELECT file_path, doc_id * 1000 AS mtime, CASE WHEN doc_id % 3 = 0 THEN size - 1 ELSE size END AS size FROM files WHERE doc_id % 7 <> 0),
    failed AS (SELECT file_path, CASE WHEN doc_id % 2 = 0 THEN doc_id * 1000 ELSE doc_id * 1000 + 1 END AS mtime, size FROM files WHERE doc_id % 13 = 0),
    ops AS (
        SELECT coalesce(now.file_path, old.file_path) AS file_path,
               CASE WHEN now.file_path IS NULL THEN 'delete' WHEN failed.mtime = now.mtime AND failed.size = now.size THEN 'failed'
                    WHEN old.file_path IS NULL THEN 'create' WHEN now.mtime <> old.mtime OR now.size <> old.size THEN 'modify' ELSE 'skip' END AS op
        FROM now FULL JOIN old ON now.file_path = old.file_path LEFT JOIN failed ON failed.file_path = coalesce(now.file_path, old.file_path))"""
_EDITED = R.ENTRIES.replace("text AS content", "CASE WHEN doc_id % 10 = 0 THEN text || ' edited edited' ELSE text END AS content")

ORACLES = {
    "jon10_sync_diff": f"{_DIFF} SELECT file_path, op FROM ops",
    "agg16_sync_counts": f"{_DIFF} SELECT op, count(*) AS n FROM ops GROUP BY op",
    "stm2_coalesced_changes": """WITH RECURSIVE c AS (
            SELECT user_id AS key, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'rename' ELSE 'modify' END AS op,
                   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
        fold AS (
            SELECT key, op AS held, i, n FROM c WHERE i = 1
            UNION ALL
            SELECT f.key, CASE WHEN held = '' THEN c.op WHEN held = 'create' AND c.op = 'delete' THEN '' WHEN held = 'modify' AND c.op = 'delete' THEN 'delete' ELSE held END, c.i, c.n
            FROM fold f JOIN c ON c.key = f.key AND c.i = f.i + 1)
        SELECT key, held AS op FROM fold WHERE i = n AND held <> ''""",
    "stm4_latest_request": "SELECT event_type AS component, arg_max(event_id, (ts, event_id)) AS request, count(*) AS n FROM events GROUP BY event_type",
    "stm5_renames": f"""WITH {R.FILES} SELECT file_path AS old_path, 'moved/' || doc_id::VARCHAR || CASE WHEN doc_id % 4 = 0 THEN '.txt' ELSE '.md' END AS new_path,
        CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 <> 0 THEN 'rename' WHEN doc_id % 3 <> 0 THEN 'delete' WHEN doc_id % 4 <> 0 THEN 'create' ELSE 'none' END AS op FROM files""",
    "snk1_upserted_chunks": f"WITH {_EDITED} SELECT file_path, count(*) AS chunks, sum(len(tokens))::BIGINT AS tokens FROM chunks GROUP BY file_path",
    "snk2_upserted_vectors": """WITH new AS (SELECT vec_id + 3 AS vec_id, list_transform(embedding, lambda x: -x) AS embedding FROM embeddings WHERE vec_id % 9 = 0),
        after AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM new) UNION ALL SELECT * FROM new)
        SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM after""",
    "snk3_incremental_postings": f"WITH {_EDITED} SELECT token, sum(tf)::BIGINT AS tf, count(*) AS df FROM (SELECT token, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS token FROM entries) GROUP BY token, chunk_id) GROUP BY token",
    "snk4_deleted_postings": f"WITH {R.ENTRIES} SELECT token, count(DISTINCT chunk_id) AS df FROM (SELECT chunk_id, unnest(tokens) AS token FROM entries WHERE file_path NOT IN (SELECT file_path FROM files WHERE doc_id % 5 = 0)) GROUP BY token",
    "flt10_failed_vectors": "SELECT 'g' || (vec_id % 40)::VARCHAR AS file_path, count(*) FILTER (vec_id % 50 = 0) AS bad_chunks, bool_or(vec_id % 50 = 0) AS failed FROM embeddings GROUP BY 1",
    "agg12_index_stats": f"WITH {R.CHUNKS} SELECT count(*) AS chunks, count(DISTINCT file_path) AS files FROM chunks",
    "agg13_corpus_stats": "SELECT count(*) AS n, sum(n_chars)::BIGINT AS sum_chars, floor(avg(n_chars) + 0.5)::BIGINT AS avg_chars, sum(strlen(text))::BIGINT AS sum_bytes, floor(avg(strlen(text)) + 0.5)::BIGINT AS avg_bytes FROM documents",
    "agg15_first_chunk": f"WITH {R.CHUNKS} SELECT file_path, array_to_string(arg_min(tokens, chunk_index), ' ') AS content, count(*) AS chunks FROM chunks GROUP BY file_path",
    "snk9_resumed_run": "SELECT item_id AS query_id, length(text) AS answer FROM benchmark",
    "jon14_resume": "SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 3 <> 0",
}
