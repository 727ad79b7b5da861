"""Corpus preparation queries: deduplication, sampling, merging, page text, as-of lookups, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.jobs import retrieval as R
from tessera.operators import prepare, scan, sequences
from tessera.sources import corpus


def set6_pages_by_url(spark, sf_dir):
    return prepare.first_by_url(corpus.table(spark, sf_dir, "pages"))


def top10_seeded_sample(spark, sf_dir):
    return prepare.sample(corpus.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50)


def top11_stratified_sample(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return prepare.stratified(d, "doc_id", F.col("lang"), {"en": 0.5, "fr": 0.3, "de": 0.2}, 101).select("doc_id", "lang")


def top12_capped_corpus(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").select("doc_id")
    return prepare.capped(d, d.where("doc_id % 17 = 0"), "doc_id", 100)


def set4_missing_ids(spark, sf_dir):
    """Labelled documents that are not there, and documents without a label."""
    d, lab = corpus.table(spark, sf_dir, "documents").select("doc_id"), corpus.table(spark, sf_dir, "labels").select("doc_id")
    return lab.subtract(d).select("doc_id", F.lit("no document").alias("why")).unionByName(d.subtract(lab).select("doc_id", F.lit("no label").alias("why")))


def set7_relevant_found(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").where("n_chars > 1000").select("doc_id")
    return d.join(corpus.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


def agg26_merged_articles(spark, sf_dir):
    c = corpus.chunks(corpus.files(spark, sf_dir)).select("file_path", "title", "chunk_index", F.array_join("tokens", " ").alias("text"))
    return prepare.merge_articles(c).select("file_path", "title", F.md5("text").alias("text_md5"), "n_chunks")


def agg27_article_statistics(spark, sf_dir):
    c = corpus.chunks(corpus.files(spark, sf_dir)).groupBy("file_path").agg(F.count("*").alias("n"))
    return c.agg(F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


def agg33_counts_by_prefix(spark, sf_dir):
    return corpus.files(spark, sf_dir).groupBy(F.regexp_extract("file_path", "^([^/]+)/", 1).alias("prefix")).agg(F.count("*").alias("n"))


def jon16_article_ids(spark, sf_dir):
    """Chunk ids to article ids, and the distinct pairs of judgements after it."""
    c = corpus.chunks(corpus.files(spark, sf_dir))
    return c.select(T.file_of(F.col("chunk_id")).alias("article"), (F.col("chunk_index") % 3).alias("query")).distinct()


def snk12_note_files(spark, sf_dir):
    """One note per document: its file name, and its title above the text."""
    f = corpus.files(spark, sf_dir)
    return f.select(F.concat(T.file_name(F.col("file_path")), F.lit(".md")).alias("name"), F.md5(T.with_title(F.col("title"), F.col("content"))).alias("text_md5"))


def snk14_extract_notes(spark, sf_dir):
    c = corpus.chunks(corpus.files(spark, sf_dir))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", F.array_join("tokens", " ").alias("t"))))
    return c.groupBy("file_path").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n")).alias("text_md5"))


def q15_read_note(spark, sf_dir):
    return snk14_extract_notes(spark, sf_dir).where("file_path = 'src3/3.md'")


def fn21_page_text(spark, sf_dir):
    return corpus.table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


def fn22_main_text(spark, sf_dir):
    return corpus.table(spark, sf_dir, "pages").select("page_id", T.main_text(F.col("html")).alias("text"))


def fn23_page_fallback(spark, sf_dir):
    """Page text, or its address where it is empty; pages with neither are dropped."""
    p = corpus.table(spark, sf_dir, "pages")
    body = F.when(F.col("page_id") % 5 != 0, T.html_to_text(F.col("html"))).otherwise("")
    text = F.coalesce(F.nullif(body, F.lit("")), F.when(F.col("page_id") % 10 != 0, F.col("url")))
    title = F.coalesce(F.nullif(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), F.lit("")), F.concat(F.lit("Page "), F.col("page_id").cast("string")))
    return p.select("page_id", title.alias("title"), text.alias("text")).where("text is not null")


def jon11_page_of_chunk(spark, sf_dir):
    """The page of each chunk; a page starts every 1000 characters, and a chunk every 700."""
    f = corpus.files(spark, sf_dir).where("size > 0")
    pages = f.select("file_path", F.posexplode(F.sequence(F.lit(0), F.col("size"), F.lit(1000))).alias("page", "start")).withColumn("page", F.col("page") + 1)
    points = f.select("file_path", F.explode(F.sequence(F.lit(-1), F.col("size"), F.lit(700))).alias("offset"))
    return sequences.as_of(points, pages, "file_path", "offset", "start", "page")


def jon12_turn_at_time(spark, sf_dir):
    """The last signup of each user at or before each of the user's purchases, or the first one."""
    e = corpus.table(spark, sf_dir, "events").select("user_id", "event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', ts)").alias("ts"), "event_type")
    buys, signups = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup"), F.col("ts").alias("start"))
    return sequences.as_of(buys, signups, "user_id", "ts", "start", "signup", else_first=True)


def _lines(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "line"))


def win8_offsets(spark, sf_dir):
    """Where each line of a document starts; a null text is one empty line."""
    return sequences.offsets(_lines(spark, sf_dir), "doc_id", ["no"], F.char_length("line"), "start").select("doc_id", "no", "start")


def win9_history(spark, sf_dir):
    """The newest turns of each conversation that fit a budget of 100 tokens, back to the first that does not."""
    c = corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.token_count(F.coalesce("text", F.lit(""))).cast("long").alias("cost"))
    return sequences.within_budget(c, "conv_id", [F.desc("turn")], F.col("cost"), 100).select("conv_id", "turn", "role", "running")


def win10_context_budget(spark, sf_dir):
    """Leading chunks of each note while they fit 2000 characters."""
    c = corpus.chunks(corpus.files(spark, sf_dir)).select("file_path", "chunk_index", F.char_length(F.array_join("tokens", " ")).cast("long").alias("cost"))
    return sequences.within_budget(c, "file_path", [F.col("chunk_index")], F.col("cost"), 2000)


def win11_heading_scope(spark, sf_dir):
    """The headings that each line stands under; a line of one to five words counts as one, of level words % 3 + 1."""
    n = F.size(F.regexp_extract_all("line", F.lit(r"\S+"), F.lit(0)))
    leveled = _lines(spark, sf_dir).select("doc_id", "no", F.when(n.between(1, 5), n % 3 + 1).alias("level"))
    d = scan.running(leveled, ["doc_id"], ["no"], {f"n{k}": ("max", F.when(F.col("level") == k, F.col("no"))) for k in (1, 2, 3)})
    h2 = F.when(F.col("n2") > F.coalesce("n1", F.lit(-1)), F.col("n2"))
    h3 = F.when(F.col("n3") > F.greatest(F.coalesce("n1", F.lit(-1)), F.coalesce("n2", F.lit(-1))), F.col("n3"))
    return d.select("doc_id", "no", F.col("n1").alias("h1"), h2.alias("h2"), h3.alias("h3"))


def src11_numbered_lines(spark, sf_dir):
    """Lines 20 to 49 of the passages as JSON lines, by their numbers."""
    b = corpus.table(spark, sf_dir, "benchmark").select("item_id", F.to_json(F.struct("item_id")).alias("value"))
    return corpus.numbered(b, "item_id", 20, 30)


def src13_tolerant_json(spark, sf_dir):
    """Event properties with control characters in every third and cut off in every fifth line."""
    e = corpus.table(spark, sf_dir, "events").select("event_id", "props")
    dirty = F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 3)).when(F.col("event_id") % 3 == 0, F.concat(F.lit("\x01"), F.col("props"))).otherwise(F.col("props"))
    lines = e.select(F.when(F.col("event_id") % 5 == 0, dirty).otherwise(F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, F.lit("\x01")).otherwise(""), F.lit("}"))).alias("value"))
    return corpus.tolerant_json(lines, "id long")


QUERIES = {
    f.__name__: f
    for f in (
        set4_missing_ids, set6_pages_by_url, set7_relevant_found, top10_seeded_sample, top11_stratified_sample, top12_capped_corpus, agg26_merged_articles,
        agg27_article_statistics, agg33_counts_by_prefix, jon16_article_ids, snk12_note_files, snk14_extract_notes, q15_read_note, fn21_page_text, fn22_main_text,
        fn23_page_fallback, jon11_page_of_chunk, jon12_turn_at_time, win8_offsets, win9_history, win10_context_budget, win11_heading_scope, src11_numbered_lines, src13_tolerant_json,
    )
}

# The character references that the pages of the test tables hold; the functions decode all that HTML has.
def _decoded(sql: str) -> str:
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        sql = f"replace({sql}, '{entity}', '{char}')"
    return sql


def _gone(sql: str, *tags: str) -> str:
    for tag in tags:
        sql = rf"regexp_replace({sql}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    return sql


# The body's text content: elements that are no content go, then tags and comments, and nothing takes their place; references after that, blanks last.
_MAIN = _gone(r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g')", "style", "head", "nav", "header", "footer", "aside", "noscript")
_MAIN = rf"regexp_replace(trim({_decoded(f"regexp_replace({_MAIN}, '<[^>]*>', '', 'g')")}, ' ' || chr(9) || chr(10) || chr(13)), '\s+', ' ', 'g')"
# Scripts, styles, comments; a line end for six kinds of opening tags; other tags; references; runs of blanks; one blank line between paragraphs.
_HTML = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
_HTML = _decoded(rf"regexp_replace(regexp_replace({_HTML}, '(?i)<(p|div|br|h[1-6]|li|tr)[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g')")
_HTML = rf"trim(regexp_replace(regexp_replace({_HTML}, '[ \t]+', ' ', 'g'), '\n\s*\n', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"
_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS no FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"
_NOTE = f"WITH {R.CHUNKS} SELECT file_path, md5(string_agg(array_to_string(tokens, ' '), chr(10) || chr(10) ORDER BY chunk_index)) AS text_md5 FROM chunks"

ORACLES = {
    "set4_missing_ids": "SELECT doc_id, 'no document' AS why FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'no label' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "set6_pages_by_url": "WITH k AS (SELECT url, min(page_id) AS page_id FROM pages WHERE trim(coalesce(url, '')) <> '' GROUP BY 1) SELECT url, page_id, row_number() OVER (ORDER BY page_id) - 1 AS doc_no FROM k",
    "set7_relevant_found": "SELECT doc_id FROM documents WHERE n_chars > 1000 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "top10_seeded_sample": "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 50",
    "top11_stratified_sample": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= CASE lang WHEN 'en' THEN 50 WHEN 'fr' THEN 30 WHEN 'de' THEN 21 ELSE 0 END",
    "top12_capped_corpus": """WITH d AS (SELECT doc_id, doc_id % 17 = 0 AS required FROM documents), n AS (SELECT count(*) AS n FROM d WHERE required)
        SELECT doc_id, required FROM (SELECT *, row_number() OVER (PARTITION BY required ORDER BY doc_id) AS r FROM d) WHERE required OR r <= greatest(0, 100 - (SELECT n FROM n))""",
    "agg26_merged_articles": f"WITH {R.CHUNKS} SELECT file_path, arg_min(title, chunk_index) AS title, md5(string_agg(array_to_string(tokens, ' '), chr(10) || chr(10) ORDER BY chunk_index)) AS text_md5, count(*) AS n_chunks FROM chunks GROUP BY file_path",
    "agg27_article_statistics": f"WITH {R.CHUNKS} SELECT round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most FROM (SELECT count(*) AS n FROM chunks GROUP BY file_path)",
    "agg33_counts_by_prefix": f"WITH {R.FILES} SELECT regexp_extract(file_path, '^([^/]+)/', 1) AS prefix, count(*) AS n FROM files GROUP BY 1",
    "jon16_article_ids": f"WITH {R.CHUNKS} SELECT DISTINCT file_path AS article, (chunk_index % 3)::INTEGER AS query FROM chunks",
    "snk12_note_files": rf"WITH {R.FILES} SELECT regexp_replace(file_path, '[/\\]', '_', 'g') || '.md' AS name, md5(CASE WHEN title <> '' THEN title || chr(10) || chr(10) || content ELSE content END) AS text_md5 FROM files",
    "snk14_extract_notes": f"{_NOTE} GROUP BY file_path",
    "q15_read_note": f"{_NOTE} WHERE file_path = 'src3/3.md' GROUP BY file_path",
    "fn21_page_text": f"SELECT page_id, {_HTML} AS text FROM pages",
    "fn22_main_text": f"SELECT page_id, {_MAIN} AS text FROM pages",
    "fn23_page_fallback": f"""SELECT * FROM (SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), ''), 'Page ' || page_id::VARCHAR) AS title,
        coalesce(nullif(CASE WHEN page_id % 5 <> 0 THEN {_HTML} ELSE '' END, ''), CASE WHEN page_id % 10 <> 0 THEN url END) AS text FROM pages) WHERE text IS NOT NULL""",
    "jon11_page_of_chunk": f"""WITH {R.FILES}, f AS (SELECT file_path, size FROM files WHERE size > 0),
        pages AS (SELECT file_path, unnest(range(0, size + 1, 1000)) AS start FROM f), points AS (SELECT file_path, unnest(range(-1, size + 1, 700)) AS "offset" FROM f)
        SELECT p.file_path, p."offset", (s.start / 1000)::BIGINT::INTEGER + 1 AS page FROM points p ASOF LEFT JOIN pages s ON p.file_path = s.file_path AND p."offset" >= s.start""",
    "jon12_turn_at_time": """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS ts, event_type FROM events),
        s AS (SELECT user_id, ts, max(event_id) AS signup FROM e WHERE event_type = 'signup' GROUP BY user_id, ts)
        SELECT b.user_id, b.event_id, b.ts, coalesce(s.signup, f.signup) AS signup FROM (SELECT * FROM e WHERE event_type = 'purchase') b ASOF LEFT JOIN s ON b.user_id = s.user_id AND b.ts >= s.ts
        LEFT JOIN (SELECT user_id, arg_min(signup, ts) AS signup FROM s GROUP BY user_id) f ON b.user_id = f.user_id""",
    "win8_offsets": f"WITH {_LINES} SELECT doc_id, no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lines",
    "win9_history": f"""SELECT conv_id, turn, role, running FROM (SELECT conv_id, turn, role, sum(len(regexp_extract_all(lower(coalesce(text, '')), {R.WORDS}))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM conversations) WHERE running <= 100""",
    "win10_context_budget": f"""WITH {R.CHUNKS}, c AS (SELECT file_path, chunk_index, length(array_to_string(tokens, ' '))::BIGINT AS cost FROM chunks)
        SELECT * FROM (SELECT *, sum(cost) OVER (PARTITION BY file_path ORDER BY chunk_index ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM c) WHERE running <= 2000""",
    "win11_heading_scope": rf"""WITH {_LINES},
        l AS (SELECT doc_id, no, CASE WHEN n BETWEEN 1 AND 5 THEN n % 3 + 1 END AS level FROM (SELECT *, len(regexp_extract_all(line, '\S+')) AS n FROM lines)),
        m AS (SELECT doc_id, no, max(no) FILTER (level = 1) OVER w AS n1, max(no) FILTER (level = 2) OVER w AS n2, max(no) FILTER (level = 3) OVER w AS n3 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING))
        SELECT doc_id, no, n1 AS h1, CASE WHEN n2 > coalesce(n1, -1) THEN n2 END AS h2, CASE WHEN n3 > greatest(coalesce(n1, -1), coalesce(n2, -1)) THEN n3 END AS h3 FROM m""",
    "src11_numbered_lines": "SELECT item_id, '{\"item_id\":' || item_id::VARCHAR || '}' AS value FROM benchmark ORDER BY item_id LIMIT 30 OFFSET 20",
    "src13_tolerant_json": "SELECT event_id AS id FROM events WHERE event_id % 5 <> 0",
}
