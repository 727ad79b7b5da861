"""Exchange formats, id and text projections, query builders for selections, and limits of reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import SearchOptions
from tessera.functions import chunker
from tessera.functions import text as T
from tessera.jobs import evaluation, preparation
from tessera.jobs import retrieval as R
from tessera.operators import prepare, ranking, search
from tessera.sources import corpus, store
from tessera.sources.scratch import scratch

#: Characters of a page's text, candidates that a reranker gets, texts of a batch.
PAGE_CHARS, RERANKED, BATCH = 8000, 100, 32


def src10_jsonl_queries(spark, sf_dir):
    """The queries as JSON lines with blank ones among them, written and read back."""
    path = scratch(spark, "queries")
    q = corpus.queries(spark, sf_dir)
    lines = q.select(F.explode(F.array(F.to_json(F.struct("query_id", "text")), F.lit("  "))).alias("value"))
    lines.write.text(path)
    return corpus.read_jsonl(spark, path, "query_id long, text string")


def src12_jsonl_corpus(spark, sf_dir):
    """Every document as a JSON line, written and read back; a null text stays one."""
    path = scratch(spark, "corpus")
    corpus.table(spark, sf_dir, "documents").select("doc_id", "text").write.json(path)
    return corpus.read_jsonl(spark, path, "doc_id long, text string").select("doc_id", F.md5("text").alias("text_md5"))


def src14_qrels(spark, sf_dir):
    """Labels as tab-separated judgements with a header; those of relevance 0 are left out on reading."""
    path = scratch(spark, "qrels")
    rows = corpus.table(spark, sf_dir, "labels").select(F.concat(F.lit("q"), F.col("doc_id") % 10).alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("quality").alias("score"))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return corpus.read_qrels(spark, path)


def src16_first_by_id(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return prepare.first_by_id(e, "user_id", "event_id")


def src17_capped_page_text(spark, sf_dir):
    return corpus.table(spark, sf_dir, "pages").select("page_id", T.capped(T.main_text(F.col("html")), PAGE_CHARS).alias("text"))


def src18_calendar_events(spark, sf_dir):
    """A feed per note: one event on a folded line, one without an end, which is left out."""
    f = corpus.files(spark, sf_dir)
    day = F.date_format(F.expr("date_add(date'2024-01-01', cast(doc_id % 300 as int))"), "yyyyMMdd")
    event = F.concat(F.lit("BEGIN:VEVENT\r\nSUMMARY;LANGUAGE=en:Note\r\n  "), "lang", F.lit("\r\nDTSTART:"), day, F.lit("T080000Z\r\nDTEND:"), day, F.lit("T093000Z\r\nEND:VEVENT\r\n"))
    feed = F.concat(F.lit("BEGIN:VCALENDAR\r\n"), event, F.lit("BEGIN:VEVENT\r\nSUMMARY:open\r\nDTSTART:20240101\r\nEND:VEVENT\r\nEND:VCALENDAR"))
    e = f.select("doc_id", F.explode(T.ical_events(feed)).alias("e"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return e.select("doc_id", F.col("e.summary").alias("summary"), stamp("e.start").alias("start"), stamp("e.end").alias("end"))


def snk11_metrics_csv(spark, sf_dir):
    """Metrics as a table of comma-separated values, one row per run, read back."""
    rows = evaluation.q16_multi_run_metrics(spark, sf_dir)
    path = scratch(spark, "metrics")
    rows.coalesce(1).write.option("header", True).csv(path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


def prj2_article_ids(spark, sf_dir):
    return corpus.files(spark, sf_dir).select("doc_id", F.regexp_replace("file_path", r"\.md$", "").alias("article"))


def prj4_shard_text(spark, sf_dir):
    f = corpus.files(spark, sf_dir)
    return f.select("doc_id", F.md5(F.concat("title", F.lit(" "), F.coalesce("content", F.lit("")))).alias("text_md5"))


def agg29_batch_tokens(spark, sf_dir):
    """Tokens of each batch of notes: their sum and the most of one."""
    n = corpus.files(spark, sf_dir).select(F.floor(F.col("doc_id") / BATCH).alias("batch"), T.token_count(F.coalesce("content", F.lit(""))).cast("long").alias("n"))
    return n.groupBy("batch").agg(F.sum("n").alias("total"), F.max("n").alias("most"))


def top7_capped_rerank(spark, sf_dir):
    """At most ``RERANKED`` candidates are scored again, and a tenth of what was asked for stays."""
    o = SearchOptions(top_k=30)
    e, q = R._entries(spark, sf_dir), corpus.queries(spark, sf_dir)
    hits = search.lexical(e, q, o).where(F.col("rank") <= min(o.limit, RERANKED)).select("query_id", "chunk_id")
    scored = search.overlap_score(q.select("query_id", T.tokens(F.col("text")).alias("tokens")), search.with_texts(e, hits, q.count() * RERANKED))
    return ranking.top_per_query(scored, o.top_k // 10, "chunk_id").select("query_id", "chunk_id", "score", "rank")


def fn12_selected_lines(spark, sf_dir):
    return chunker.mapped(corpus.files(spark, sf_dir), lambda text, title: chunker.selection(text, 1, 5, 40))


def fn13_selected_text(spark, sf_dir):
    """Each whole text as a selection, in a context of 200 tokens."""
    return chunker.mapped(corpus.files(spark, sf_dir), lambda text, title: chunker.selected_query(text, title, 128, 200))


def fn16_char_truncate(spark, sf_dir):
    return chunker.mapped(corpus.files(spark, sf_dir), lambda text, title: text[: chunker.longest_prefix(text, 20, chunker.count_words)])


def fn18_shrunk(spark, sf_dir):
    return chunker.mapped(corpus.files(spark, sf_dir), lambda text, title: chunker.fit(text, 64))


QUERIES = {
    f.__name__: f
    for f in (
        src10_jsonl_queries, src12_jsonl_corpus, src14_qrels, src16_first_by_id, src17_capped_page_text, src18_calendar_events, snk11_metrics_csv, prj2_article_ids,
        prj4_shard_text, agg29_batch_tokens, top7_capped_rerank, fn12_selected_lines, fn13_selected_text, fn16_char_truncate, fn18_shrunk,
    )
}

_DAY = "strftime(DATE '2024-01-01' + (doc_id % 300)::INTEGER, '%Y-%m-%d')"

ORACLES = {
    "src10_jsonl_queries": "SELECT item_id AS query_id, text FROM benchmark",
    "src12_jsonl_corpus": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "src14_qrels": "SELECT 'q' || (doc_id % 10)::VARCHAR AS query_id, doc_id::VARCHAR AS doc_id, quality::INTEGER AS relevance FROM labels WHERE quality > 0",
    "src16_first_by_id": "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "src17_capped_page_text": f"SELECT page_id, CASE WHEN length(t) > {PAGE_CHARS} THEN substr(t, 1, {PAGE_CHARS}) || chr(10) || '[truncated]' ELSE t END AS text FROM (SELECT page_id, {preparation._MAIN} AS t FROM pages)",
    "src18_calendar_events": f"SELECT doc_id, 'Note ' || lang AS summary, {_DAY} || ' 08:00:00' AS start, {_DAY} || ' 09:30:00' AS \"end\" FROM documents",
    "snk11_metrics_csv": evaluation.ORACLES["q16_multi_run_metrics"],
    "prj2_article_ids": "SELECT doc_id, source || '/' || doc_id::VARCHAR AS article FROM documents",
    "prj4_shard_text": f"WITH {R.FILES} SELECT doc_id, md5(title || ' ' || coalesce(content, '')) AS text_md5 FROM files",
    "agg29_batch_tokens": f"""SELECT doc_id // {BATCH} AS batch, sum(n)::BIGINT AS total, max(n) AS most
        FROM (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), {R.WORDS}))::BIGINT AS n FROM documents) GROUP BY 1""",
    "top7_capped_rerank": f"WITH {R.BM25} {R._top(R._fill(R._RERANK, R._lexical(100)), 3, 'chunk_id', 'query_id, chunk_id, score, rank')}",
    # Lines two to six while their words stay within 40; then, if more than ten are left or nothing is taken, the words of the next line up to the first too many.
    "fn12_selected_lines": rf"""WITH {R.FILES}, l AS (SELECT file_path, unnest(list_slice(string_split(coalesce(content, ''), chr(10)), 2, 6)) AS line, unnest(range(5))::INTEGER AS no FROM files),
        c AS (SELECT *, sum(n) OVER (PARTITION BY file_path ORDER BY no) AS upto FROM (SELECT file_path, no, line, len(regexp_extract_all(line, {R.WORDS})) AS n FROM l WHERE line IS NOT NULL)),
        kept AS (SELECT file_path, string_agg(line, chr(10) ORDER BY no) AS taken, max(upto) AS used, max(no) AS last FROM c WHERE upto <= 40 GROUP BY file_path),
        next AS (SELECT c.file_path, c.line, coalesce(40 - used, 40) AS room FROM c LEFT JOIN kept USING (file_path) WHERE c.no = coalesce(last, -1) + 1),
        words AS (SELECT file_path, room, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT *, regexp_split_to_array(line, '\s+') AS w FROM next WHERE room > 10)),
        begun AS (SELECT file_path, string_agg(word, ' ' ORDER BY i) AS part FROM (SELECT *, sum(len(regexp_extract_all(word, {R.WORDS}))) OVER (PARTITION BY file_path ORDER BY i) AS upto FROM words) WHERE upto <= room GROUP BY file_path)
        SELECT file_path, CASE WHEN taken IS NULL THEN coalesce(part, '') WHEN next.file_path IS NULL OR room <= 10 THEN taken ELSE taken || chr(10) || coalesce(part, '') END AS text
        FROM files LEFT JOIN kept USING (file_path) LEFT JOIN next USING (file_path) LEFT JOIN begun USING (file_path)""",
    # A fifth goes until at most 64 words or 100 characters are left.
    "fn18_shrunk": rf"""WITH RECURSIVE {R.FILES}, cut AS (
            SELECT file_path, coalesce(content, '') AS text FROM files
            UNION ALL
            SELECT file_path, left(text, floor(length(text) * 0.8::DOUBLE)::BIGINT) FROM cut WHERE length(text) > 100 AND len(regexp_extract_all(text, {R.WORDS})) > 64)
        SELECT file_path, arg_min(text, length(text)) AS text FROM cut GROUP BY file_path""",
    "fn16_char_truncate": rf"WITH {R.FILES} SELECT file_path, regexp_extract(coalesce(content, ''), '^(?:[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]+){{0,20}}[^\p{{L}}\p{{N}}]*') AS text FROM files",
}
