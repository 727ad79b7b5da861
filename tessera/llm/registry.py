"""Registered queries of this subpackage, one per operator, and the SQL they are compared with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, jaccard_join, line_dedup, mixing, phrases, prefix_trie, sharding, token_files, topk_search, toxicity, transducer, warc
from .common import lower_az, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(lower_az(F.coalesce("text", F.lit(""))), 256)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", digest.alias("text_sha256"))
    return exact_dedup.exact_dedup(docs, carry=["doc_id", "text_sha256"], digest=F.col("text_sha256"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixing.WEIGHTS)
    return mixed.select(
        "doc_id", "source", F.round("mean_copies", 9).alias("mean_copies"), "copy_no", "position",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % toxicity.FOLDS == 0).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return out.select(F.col("row.page_id").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "headers", "block", "block_digest", "block_length")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return token_files.read_digest(spark, path)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, carry=["doc_id"]).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposes = F.pmod(F.xxhash64("doc_id"), F.lit(phrases.RATE)) == 0
    return phrases.collocations(table(spark, sf_dir, "documents"), sample=proposes)


def op12_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return transducer.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, carry=["doc_id"]).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_topk_search": op3_topk_search,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_warc": op8_warc,
    "op9_token_files": op9_token_files,
    "op10_bpe": op10_bpe,
    "op11_phrases": op11_phrases,
    "op12_transducer": op12_transducer,
    "op13_prefix_trie": op13_prefix_trie,
}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WEIGHT = "CASE pool " + " ".join(f"WHEN '{s}' THEN {w!r}::DOUBLE" for s, w in mixing.WEIGHTS.items()) + f" ELSE {max(0.0, 1.0 - sum(mixing.WEIGHTS.values()))!r}::DOUBLE END"
_NAMED = ", ".join(f"'{s}'" for s in mixing.WEIGHTS)


def _fraction(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT"


_ID = "coalesce(doc_id::VARCHAR, 'null')"

_TEXT = "payload"
_TEXT = f"regexp_replace({_TEXT}, '{warc.DROPPED}', '', 'g')"
_TEXT = f"regexp_replace(regexp_replace({_TEXT}, '{warc.BREAKS}', chr(10), 'g'), '{warc.TAG}', '', 'g')"
# The character references that the pages of the test tables hold; the operator decodes all that HTML has.
for _entity, _char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
    _TEXT = "replace({}, '{}', '{}')".format(_TEXT, _entity, _char.replace("'", "''"))
_TEXT = f"regexp_replace(regexp_replace({_TEXT}, '{warc.BLANKS}', ' ', 'g'), '{warc.LINE_ENDS}', chr(10), 'g')"
_TEXT = f"regexp_replace({_TEXT}, '^[ \\n]+|[ \\n]+$', '', 'g')"


def _urn(text: str) -> str:
    cut = " || '-' || ".join(f"substr(md5({text}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {cut} || '>'"


_CRLF = "chr(13) || chr(10)"


def _line(name: str, value: str) -> str:
    return f"coalesce('{name}: ' || {value} || {_CRLF}, '')"


#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda c, d: list_reduce(list_concat([xor(c, d)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

ORACLES = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_NORM} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op3_topk_search": """
        WITH v AS (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        pairs AS (
            SELECT q.rid AS qid, q.vec_id AS query_id, c.rid, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.rid <> c.rid AND len(q.v) = len(c.v)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id, rid) AS rank FROM pairs)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op4_mixing": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, strlen(coalesce(text, '')) AS n_bytes,
                   CASE WHEN source IN ({_NAMED}) THEN source END AS pool FROM documents),
        sizes AS (SELECT pool, sum(n_bytes + 1)::BIGINT AS size FROM d GROUP BY pool),
        rate AS (SELECT pool, {_WEIGHT} * (SELECT sum(size)::BIGINT FROM sizes) / size AS rate FROM sizes),
        lots AS (SELECT pool, rate, greatest(1, ceil(rate / {mixing.LOT_RATE}))::BIGINT AS lots FROM rate),
        cdf AS (
            SELECT pool, rate, lots, 0 AS k, exp(-(rate / lots)) AS p, exp(-(rate / lots)) AS c FROM lots
            UNION ALL
            SELECT pool, rate, lots, k + 1, p * (rate / lots) / (k + 1), c + p * (rate / lots) / (k + 1) FROM cdf WHERE k < {mixing.TERMS}),
        steps AS (SELECT pool, rate, lots, list(c ORDER BY k) AS cs FROM cdf GROUP BY pool, rate, lots),
        drawn AS (
            SELECT doc_id, source, n_bytes, rate, cs, unnest(range(lots)) AS lot
            FROM d JOIN steps ON d.pool IS NOT DISTINCT FROM steps.pool),
        counted AS (
            SELECT *, ({_fraction(f"'{mixing.SEED}'", _ID, "lot::VARCHAR")} + 0.5::DOUBLE) / {float(mixing.SPAN)!r}::DOUBLE AS u FROM drawn),
        copies AS (
            SELECT doc_id, source, n_bytes, rate, lot, unnest(range(len(list_filter(cs, lambda c: c <= u)))) AS copy FROM counted)
        SELECT doc_id, source, round(rate, 9) AS mean_copies, (lot * {mixing.TERMS + 2} + copy)::BIGINT AS copy_no,
               {_fraction(f"'{mixing.SEED}'", "'place'", _ID, "lot::VARCHAR", "copy::VARCHAR")} AS position, n_bytes
        FROM copies""",
    "op8_warc": f"""
        WITH p AS (SELECT page_id, regexp_replace(url, '[\\r\\n]+', '', 'g') AS target_uri, coalesce(html, '') AS payload FROM pages),
        r AS (SELECT *, {_urn("'response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(target_uri, '') || '|' || sha256(payload)")} AS refers_to,
                     'sha256:' || sha256(payload) AS payload_digest, {_TEXT} AS txt FROM p),
        i AS (SELECT *, {_urn("'conversion|' || refers_to")} AS conversion_id, {_urn("'metadata|' || refers_to")} AS metadata_id FROM r),
        b AS (
            SELECT page_id, refers_to, target_uri, payload_digest, 'conversion' AS record_type, conversion_id AS record_id, 'text/plain' AS ct, txt AS block FROM i
            UNION ALL
            SELECT page_id, refers_to, target_uri, payload_digest, 'metadata', metadata_id, 'application/warc-fields',
                {" || ".join([
                    _line("source-record-id", "refers_to"),
                    _line("source-http-headers", "('HTTP/1.1 200 OK | Content-Type: text/html; charset=utf-8 | Content-Length: ' || strlen(payload)::VARCHAR)"),
                    _line("source-payload-digest", "payload_digest"),
                    _line("source-payload-length", "strlen(payload)::VARCHAR"),
                    _line("conversion-record-id", "conversion_id"),
                    _line("conversion-digest", "('sha256:' || sha256(txt))"),
                ])} FROM i)
        SELECT page_id, record_type, record_id, refers_to, target_uri,
               'WARC/1.1' || {_CRLF} || {" || ".join([
                   _line("WARC-Type", "record_type"), _line("WARC-Record-ID", "record_id"), _line("WARC-Refers-To", "refers_to"),
                   _line("WARC-Target-URI", "target_uri"), _line("WARC-Date", f"'{warc.DATE}'"), _line("WARC-Source-Payload-Digest", "payload_digest"),
                   _line("WARC-Block-Digest", "('sha256:' || sha256(block))"), _line("Content-Type", "ct"), _line("Content-Length", "strlen(block)::VARCHAR"),
               ])} AS headers,
               block, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS block_length
        FROM b""",
    "op11_phrases": f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_NORM}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        ws AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
        grams AS (
            SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
            FROM ws, range(1, 5) t(m) WHERE len(w) >= m),
        f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM ws GROUP BY lang),
        cut AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
        scored AS (
            SELECT c.*, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score FROM cut c
            JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
        worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inner_ AS (
            SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda j: list_transform(range(1, m - j + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i + j - 1], ' '))))) AS phrase
            FROM f WHERE m > 2),
        longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL),
        kept AS (SELECT w.* FROM worst w LEFT JOIN longer x ON x.lang = w.lang AND x.phrase = w.phrase WHERE x.longer IS NULL OR 100 * x.longer < 80 * w.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000""",
    "op13_prefix_trie": f"""
        WITH o AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
        mixed AS (
            SELECT c.conv_id, 0 AS part, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.pos <= h
            UNION ALL
            SELECT c.conv_id, 1, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > h),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM mixed),
        paths AS (
            SELECT conv_id, 0 AS depth, '' AS key, '' AS text FROM c
            UNION ALL
            SELECT conv_id, depth, sha256(string_agg(strlen(role)::VARCHAR || ':' || role || strlen(text)::VARCHAR || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth)), text FROM placed),
        ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM paths),
        nodes AS (
            SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words,
                   string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last) AS ids FROM ended GROUP BY depth, key),
        linked AS (
            SELECT n.*, up.key AS up FROM nodes n LEFT JOIN paths up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1),
        children AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
        known AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children USING (depth, key)),
        sums AS (
            SELECT a.depth, a.key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
            FROM known k JOIN paths a ON a.conv_id = k.conv_id AND a.depth <= k.depth GROUP BY ALL)
        SELECT k.conv_id, k.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(k.ids, '')) AS ends_sha256
        FROM known k JOIN sums USING (depth, key) LEFT JOIN nodes p ON p.depth = k.depth - 1 AND p.key = k.up""",
}
