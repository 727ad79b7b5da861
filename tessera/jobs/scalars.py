"""Scalar functions, chunkers and query builders on the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.config import SearchOptions
from tessera.functions import chunker
from tessera.functions import text as T
from tessera.jobs import retrieval as R
from tessera.operators import ranking, search, sequences
from tessera.sources import corpus
from tessera.streaming import changes


def _docs(spark, sf_dir):
    """Documents; a null text is an empty one."""
    return corpus.table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def fn5_line_chunks(spark, sf_dir):
    return chunker.chunk_notes(corpus.files(spark, sf_dir), 128, 16)


def fn10_char_windows(spark, sf_dir):
    return chunker.window_notes(corpus.files(spark, sf_dir))


def fn11_note_queries(spark, sf_dir):
    return chunker.note_queries(corpus.files(spark, sf_dir))


def fn15_word_truncate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.truncate_words(F.col("text"), 20).alias("head"))


def fn19_frontmatter(spark, sf_dir):
    note = F.concat(F.lit("---\na: 1\nb: 2\n---\n"), "text")
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.blank_frontmatter(F.when(F.col("doc_id") % 2 == 0, note).otherwise(F.concat(F.lit("."), "text")))).alias("text_md5"))


def fn20_tidy(spark, sf_dir):
    spaced = F.replace("text", F.lit(". "), F.lit(".\t \n\n\n\n "))
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.tidy(spaced)).alias("text_md5"))


def fn20_nfkc(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalised(F.col("text"))).alias("text_md5"))


def fn24_controls(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.strip_controls(F.concat(F.lit("\x01\t"), "text", F.lit("\x1f")))).alias("text_md5"))


def fn25_transcript(spark, sf_dir):
    """Transcript lines of conversations: start, end, text, and where each starts in the joined text."""
    c = corpus.table(spark, sf_dir, "conversations")
    stamp = lambda x: F.format_string("%02d:%02d:%02d.%03d", (x / 3600).cast("int"), (x / 60).cast("int") % 60, (x % 60).cast("int"), F.lit(250))
    line = F.format_string("[%s --> %s]  %s", stamp(F.col("turn") * 75), stamp(F.col("turn") * 75 + 70), F.coalesce("text", F.lit("")))
    lines = c.select("conv_id", "turn", line.alias("line"))
    part = lambda i: F.regexp_extract("line", r"^\[(\d+):(\d+):(\d+\.\d+) --> (\d+):(\d+):(\d+\.\d+)\]\s*(?s)(.*)$", i)
    at = lambda i: part(i).cast("int") * 3600 + part(i + 1).cast("int") * 60 + part(i + 2).cast("double")
    said = lines.select("conv_id", "turn", F.round(at(1), 3).alias("start"), F.round(at(4), 3).alias("end"), F.trim(part(7)).alias("text")).where("text <> ''")
    placed = sequences.offsets(said, "conv_id", ["turn"], F.char_length("text"), "offset")
    return placed.select("conv_id", "turn", "start", "end", F.md5("text").alias("text_md5"), "offset")


def fn26_context(spark, sf_dir):
    f = corpus.files(spark, sf_dir)
    heads = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("top"), F.col("lang"))).otherwise(F.array().cast("array<string>"))
    return f.select("doc_id", T.context_block(F.col("file_path"), heads, F.col("title")).alias("block"))


def fn27_char_budget(spark, sf_dir):
    """Each text in a budget of 100 tokens, and in one that the notice alone fills."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.truncate_chars(F.col("text"), 100)).alias("text_md5"), T.truncate_chars(F.col("text"), 20).alias("small"))


def fn28_grade(spark, sf_dir):
    """Answers made of titles: some refuse, some are right, some are an alternative, others are wrong."""
    f = corpus.files(spark, sf_dir)
    said = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Sorry, I DON'T know "), F.col("title"))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("  "), F.col("title"))).when(F.col("doc_id") % 5 == 2, F.col("lang")).otherwise("x")
    return f.select("doc_id", T.grade(said, F.col("title"), F.array(F.lit(""), F.col("lang"))).alias("grade"))


def fn29_chunk_ids(spark, sf_dir):
    e = corpus.index_entries(corpus.files(spark, sf_dir)).select("chunk_id")
    return e.select("chunk_id", T.file_of(F.col("chunk_id")).alias("file_path"), T.index_of(F.col("chunk_id")).alias("chunk_index"))


def fn30_names(spark, sf_dir):
    return corpus.files(spark, sf_dir).select("doc_id", T.file_name(F.concat("file_path", F.lit("\\x"))).alias("file"), T.store_name(F.concat(F.lit("My Vault "), F.col("file_path"))).alias("store"))


def fn31_labels(spark, sf_dir):
    ms = F.col("doc_id") * 7919 + 1234
    return corpus.files(spark, sf_dir).select("doc_id", T.query_label(F.concat(F.lit(" "), F.regexp_replace("title", " ", " \n"))).alias("label"), T.duration(ms).alias("duration"), T.byte_size(F.col("size") * F.col("size") * F.col("size")).alias("bytes"))


def fn32_calendar(spark, sf_dir):
    day = F.expr("date_add(date'2024-01-01', cast(doc_id % 300 as int))")
    stamp = F.when(F.col("doc_id") % 3 == 0, F.date_format(day, "yyyyMMdd")).when(F.col("doc_id") % 3 == 1, F.concat(F.date_format(day, "yyyyMMdd"), F.lit("T093000Z"))).otherwise("soon")
    return corpus.files(spark, sf_dir).select("doc_id", F.date_format(T.ical_time(stamp), "yyyy-MM-dd HH:mm:ss").alias("at"), T.ical_text(F.concat("title", F.lit(r"\, a\; b\n"))).alias("text"))


def fn33_tasks(spark, sf_dir):
    f = corpus.files(spark, sf_dir)
    today = F.to_date(F.lit("2024-03-01"))
    day = F.expr("date_add(date'2024-02-25', cast(doc_id % 11 as int))")
    return f.select("doc_id", T.task_text(F.concat(F.lit("#todo "), F.col("title"), F.lit(" [due:: x] #home/a"))).alias("text"), T.day_label(F.to_timestamp(F.concat(day.cast("string"), F.lit(" 14:05:00"))), today, F.col("doc_id") % 2 == 0).alias("day"))


def flt12_tasks(spark, sf_dir):
    """Tasks by status and tag, in a range of days, in order."""
    f = corpus.files(spark, sf_dir).withColumn("day", F.expr("date_add(date'2024-02-25', cast(doc_id % 11 as int))"))
    f = f.withColumn("status", F.when(F.col("doc_id") % 4 == 0, "done").otherwise("open")).withColumn("tags", F.array(F.concat(F.lit("#"), F.col("lang")), F.concat(F.lit("#"), F.col("source"))))
    kept = f.where(F.col("status").isin("open") & F.arrays_overlap("tags", F.array(F.lit("#en"), F.lit("#src3"))) & F.col("day").between("2024-02-27", "2024-03-02"))
    return kept.orderBy("day", "doc_id").select("doc_id", F.col("day").cast("string").alias("day"))


def fn34_scores(spark, sf_dir):
    v = corpus.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    return v.select("vec_id", "pos", F.round(2 * F.col("x") - 1, 6).alias("cosine"), F.round(1 - F.col("x"), 6).alias("similarity"))


def fn35_graph(spark, sf_dir):
    """Nodes and links of the star around each query: size by file size, strength by score."""
    hits = ranking.top_per_query(ranking.aggregate_files(search.lexical(R._entries(spark, sf_dir), corpus.queries(spark, sf_dir), SearchOptions()), "max_p"), 10, "file_path")
    sized = hits.join(corpus.files(spark, sf_dir).select("file_path", "size"), "file_path")
    most = F.max("size").over(Window.partitionBy("query_id"))
    return sized.select(F.col("query_id").alias("source"), F.col("file_path").alias("target"), F.round(12 * (0.5 + 0.5 * F.col("size") / most), 6).alias("node_size"), F.col("score").alias("strength"))


def q14_related_notes(spark, sf_dir):
    """For every note: other notes like it, by the query built from it."""
    notes = corpus.files(spark, sf_dir)
    q = chunker.note_queries(notes).select(F.col("file_path").alias("query_id"), "text")
    hits = ranking.aggregate_files(search.lexical(R._entries(spark, sf_dir), q, SearchOptions(top_k=11)), "max_p")
    return ranking.top_per_query(hits.where("file_path <> query_id").select("query_id", "file_path", "score"), 10, "file_path")


def stm1_streamed_changes(spark, sf_dir):
    return changes.replayed(spark, f"{sf_dir}/events.parquet")


def stm3_debounced_changes(spark, sf_dir):
    """Bursts of each user's changes, each given out once after an hour without one."""
    return changes.replayed_bursts(spark, f"{sf_dir}/events.parquet")


def stm9_windowed_events(spark, sf_dir):
    return changes.windowed(spark, f"{sf_dir}/events.parquet")


QUERIES = {
    f.__name__: f
    for f in (
        fn5_line_chunks, fn10_char_windows, fn11_note_queries, fn15_word_truncate, fn19_frontmatter, fn20_tidy, fn20_nfkc, fn24_controls, fn25_transcript, fn26_context,
        fn27_char_budget, fn28_grade, fn29_chunk_ids, fn30_names, fn31_labels, fn32_calendar, fn33_tasks, flt12_tasks, fn34_scores, fn35_graph, q14_related_notes,
        stm1_streamed_changes, stm3_debounced_changes, stm9_windowed_events,
    )
}

_D = "(SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)"
_REFUSED = " OR ".join("contains(said, '{}')".format(p.replace("'", "''")) for p in T.REFUSALS)
_DAY = "(DATE '2024-02-25' + (doc_id % 11)::INTEGER)"

_WHOLE = "coalesce(title, '') || chr(10) || chr(10) || coalesce(content, '')"


def _stop(mark: str) -> str:
    """Where a two-character mark stands last in the last 200 characters before ``start + 7500``, counted from 0 there; -1 if nowhere."""
    region, turned = "substr(whole, start + 7301, 200)", mark.split(" || ")[::-1]
    found = f"strpos(reverse({region}), {' || '.join(turned)})"
    return f"CASE WHEN {found} > 0 THEN 199 - {found} ELSE -1 END"


_PARAGRAPH, _FULL_STOP = _stop("chr(10) || chr(10)"), f"greatest({_stop("'.' || ' '")}, {_stop("'.' || chr(10)")})"
_END = f"start + CASE WHEN start + 7500 >= length(whole) THEN 7500 WHEN {_PARAGRAPH} > 0 THEN 7302 + {_PARAGRAPH} WHEN {_FULL_STOP} > 0 THEN 7302 + {_FULL_STOP} ELSE 7500 END"

ORACLES = {
    "fn10_char_windows": rf"""WITH RECURSIVE {R.FILES}, t AS (SELECT file_path, {_WHOLE} AS whole FROM files),
        w AS (
            SELECT file_path, whole, 0::BIGINT AS start FROM t WHERE length(whole) > 7500
            UNION ALL
            SELECT file_path, whole, ({_END}) - 500 FROM w WHERE ({_END}) - 500 < length(whole)),
        cut AS (SELECT file_path, start, regexp_replace(substr(whole, start + 1, ({_END}) - start), '^\s+|\s+$', '', 'g') AS content FROM w)
        SELECT file_path, 0::INTEGER AS chunk_index, whole AS content FROM t WHERE length(whole) <= 7500
        UNION ALL SELECT file_path, (row_number() OVER (PARTITION BY file_path ORDER BY start) - 1)::INTEGER, content FROM cut WHERE content <> ''""",
    "fn15_word_truncate": rf"SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, '\S+'), 1, 20), ' ') AS head FROM {_D}",
    "fn19_frontmatter": f"SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || chr(10) || chr(10) || text ELSE '.' || text END) AS text_md5 FROM {_D}",
    "fn20_tidy": rf"""WITH a AS (SELECT doc_id, replace(text, '. ', '.' || chr(9) || ' ' || chr(10) || chr(10) || chr(10) || chr(10) || ' ') AS t FROM {_D}),
        b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[\t\r\f\x0B]+', ' ', 'g'), ' +', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM a)
        SELECT doc_id, md5(trim(regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda l: trim(l)), chr(10)), '^\n+|\n+$', '', 'g'))) AS text_md5 FROM b""",
    "fn24_controls": rf"SELECT doc_id, md5(chr(9) || regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS text_md5 FROM {_D}",
    "fn25_transcript": r"""WITH s AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '^[\s\x0B]+', '')) AS said FROM conversations)
        SELECT conv_id, turn, round((turn * 75)::BIGINT + 0.25::DOUBLE, 3) AS start, round((turn * 75 + 70)::BIGINT + 0.25::DOUBLE, 3) AS "end", md5(said) AS text_md5,
               coalesce(sum(length(said) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM s WHERE said <> ''""",
    "fn26_context": f"WITH {R.FILES} SELECT doc_id, '[[' || regexp_replace(file_path, '\\.md$', '') || CASE WHEN doc_id % 2 = 0 THEN '#' || lang ELSE '' END || ']]' || chr(10) || title AS block FROM files",
    # 400 characters, of which the notice takes its own; back to the last line end (at a place counted from 0) if that lies beyond four fifths.
    "fn27_char_budget": f"""WITH n AS (SELECT '{T.CUT_NOTICE}' AS notice), c AS (SELECT doc_id, text, notice, 400 - length(notice) AS room FROM {_D}, n),
        e AS (SELECT *, substr(text, 1, room) AS cut, length(substr(text, 1, room)) - strpos(reverse(substr(text, 1, room)), chr(10)) AS line_end FROM c)
        SELECT doc_id, md5(CASE WHEN length(text) <= 400 THEN text WHEN strpos(cut, chr(10)) > 0 AND line_end > room * 0.8::DOUBLE THEN substr(cut, 1, line_end) || notice ELSE cut || notice END) AS text_md5,
               CASE WHEN length(text) <= 80 THEN text ELSE '{T.NO_ROOM}' END AS small FROM e""",
    "fn28_grade": f"""WITH {R.FILES}, s AS (SELECT *, trim(lower(CASE doc_id % 5 WHEN 0 THEN 'Sorry, I DON''T know ' || title WHEN 1 THEN '  ' || title WHEN 2 THEN lang ELSE 'x' END)) AS said FROM files)
        SELECT doc_id, CASE WHEN {_REFUSED} THEN 'missing' WHEN said = trim(lower(title)) OR said = lang THEN 'correct' END AS grade FROM s""",
    "fn29_chunk_ids": f"WITH {R.ENTRIES} SELECT chunk_id, file_path, TRY_CAST(split_part(chunk_id, '#', 2) AS INTEGER) AS chunk_index FROM entries",
    "fn30_names": rf"WITH {R.FILES} SELECT doc_id, regexp_replace(file_path || '\x', '[/\\]', '_', 'g') AS file, lower(regexp_replace('My Vault ' || file_path, '[^A-Za-z0-9_-]', '_', 'g')) AS store FROM files",
    "fn31_labels": f"""WITH {R.FILES}, t AS (SELECT *, doc_id * 7919 + 1234 AS ms, floor((doc_id * 7919 + 1234) / 1000::DOUBLE)::BIGINT AS s, size::BIGINT * size * size AS b FROM files),
        k AS (SELECT *, CASE WHEN b = 0 THEN 0 ELSE least(3, floor(log(b) / log(1024::DOUBLE)))::INTEGER END AS k FROM t)
        SELECT doc_id, '"' || CASE WHEN length(title) > 30 THEN substr(title, 1, 30) || '...' ELSE title END || '"' AS label,
               CASE WHEN s < 60 THEN printf('%.2fs', floor(ms / 10.0::DOUBLE + 0.5) / 100.0::DOUBLE)
                    WHEN s < 3600 THEN CASE WHEN s % 60 > 0 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%dm', s // 60) END
                    WHEN (s // 60) % 60 > 0 THEN printf('%dh %dm', s // 3600, (s // 60) % 60) ELSE printf('%dh', s // 3600) END AS duration,
               CASE WHEN b IS NULL THEN NULL WHEN b = 0 THEN '0 Bytes' ELSE regexp_replace(printf('%.2f', floor(b / pow(1024::DOUBLE, k) * 100 + 0.5) / 100), '\\.?0+$', '') || ' ' || ['Bytes', 'KB', 'MB', 'GB'][k + 1] END AS bytes FROM k""",
    "fn32_calendar": f"""WITH {R.FILES} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN strftime(DATE '2024-01-01' + (doc_id % 300)::INTEGER, '%Y-%m-%d') || ' 00:00:00' WHEN 1 THEN strftime(DATE '2024-01-01' + (doc_id % 300)::INTEGER, '%Y-%m-%d') || ' 09:30:00' END AS "at",
        title || ', a; b' || chr(10) AS text FROM files""",
    # Tags leave what follows the hash's word; later days are short dates, and events with a time show it.
    "fn33_tasks": f"""WITH {R.FILES}, d AS (SELECT doc_id, title, {_DAY} AS day, datediff('day', DATE '2024-03-01', {_DAY}) AS n FROM files)
        SELECT doc_id, trim(' ' || regexp_replace(title, '#[A-Za-z0-9_]+', '', 'g') || '  /a') AS text,
               CASE WHEN n = 0 THEN 'Today' WHEN n = 1 THEN 'Tomorrow' WHEN n = -1 THEN 'Yesterday' WHEN n < 0 THEN (-n)::VARCHAR || ' days ago' ELSE strftime(day, '%b %-d') END || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' 02:05 PM' END AS day FROM d""",
    "flt12_tasks": f"WITH {R.FILES} SELECT doc_id, {_DAY}::VARCHAR AS day FROM files WHERE doc_id % 4 <> 0 AND (lang = 'en' OR source = 'src3') AND {_DAY} BETWEEN DATE '2024-02-27' AND DATE '2024-03-02'",
    "fn34_scores": "SELECT vec_id, pos, round(2 * x::DOUBLE - 1, 6) AS cosine, round(1 - x::DOUBLE, 6) AS similarity FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding)))::INTEGER AS pos FROM embeddings)",
    "fn35_graph": f"""WITH {R.BM25}, t AS ({R._top(R._files(R._lexical(), "max_p"), 10, "file_path", "query_id, file_path, score")})
        SELECT query_id AS source, t.file_path AS target, round(12 * (0.5::DOUBLE + 0.5::DOUBLE * size / max(size) OVER (PARTITION BY query_id)), 6) AS node_size, score AS strength FROM t JOIN files USING (file_path)""",
    "stm3_debounced_changes": """WITH RECURSIVE e AS (
            SELECT user_id AS key, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'rename' ELSE 'modify' END AS op,
                   coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 1 HOUR, false)::INTEGER AS fresh FROM events),
        b AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ts, seq) AS burst FROM e),
        c AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY key, burst) AS n, max(ts) OVER (PARTITION BY key, burst) AS last FROM b WINDOW w AS (PARTITION BY key, burst ORDER BY ts, seq)),
        fold AS (
            SELECT key, burst, op AS held, i, n, last FROM c WHERE i = 1
            UNION ALL
            SELECT f.key, f.burst, CASE WHEN held = '' THEN c.op WHEN held = 'create' AND c.op = 'delete' THEN '' WHEN held = 'modify' AND c.op = 'delete' THEN 'delete' ELSE held END, c.i, c.n, c.last
            FROM fold f JOIN c ON c.key = f.key AND c.burst = f.burst AND c.i = f.i + 1)
        SELECT key, date_trunc('millisecond', last) + INTERVAL 1 HOUR AS fired, n, held AS op FROM fold WHERE i = n AND date_trunc('millisecond', last) + INTERVAL 1 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM events))""",
    "stm9_windowed_events": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
from tessera.jobs.maintenance import ORACLES as _MAINTENANCE  # noqa: E402

ORACLES["stm1_streamed_changes"] = _MAINTENANCE["stm2_coalesced_changes"]
