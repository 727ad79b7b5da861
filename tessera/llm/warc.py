"""Derivatives of web captures: linked WARC metadata and plain-text conversion records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import unescape

from .common import packed, quoted, without

DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
# Parts of a page that are not text, and tags that end a line.
DROPPED = "(?is)<!--.*?-->|" + "|".join(rf"<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in ("script", "style", "noscript", "template"))
BREAKS = r"(?i)</?(address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
TAG = r"<[^>]*>"
BLANKS = r"[ \t\r\f\x0B]+"
LINE_ENDS = r" ?\n[ \n]*"


def plain_text(html: Column) -> Column:
    """The text of a page: without scripts, comments and tags, a line per block, all character references decoded once, on Arrow batches."""
    text = F.regexp_replace(html, DROPPED, "")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAG, "")
    text = unescape(text)
    text = F.regexp_replace(F.regexp_replace(text, BLANKS, " "), LINE_ENDS, "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def _urn(*parts: Column | str) -> Column:
    """A record id from a hash, so that a second run names the same records."""
    h = F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def _fields(*pairs: tuple[str, Column]) -> Column:
    """``name: value`` lines; a null value leaves its line out."""
    return F.concat_ws("", *[F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)) for name, value in pairs])


def responses(pages: DataFrame, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a table of fetched pages.

    A null page is an empty payload; a null address has no target. Line ends are
    dropped from addresses, as a header cannot hold them. Rows alike in id, address and page
    get the same record id. Columns: row (the page's other columns), record_id, target_uri, date,
    http_headers, payload, payload_digest.
    """
    payload = F.coalesce(quoted(html_col)[0], F.lit(""))
    uri = F.regexp_replace(quoted(url_col)[0], r"[\r\n]+", "")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF * 2))
    return pages.select(
        packed(pages, html_col).alias("row"),
        _urn("response", quoted(id_col)[0], uri, F.sha2(payload, 256)).alias("record_id"),
        uri.alias("target_uri"),
        F.lit(date).alias("date"),
        head.alias("http_headers"),
        payload.alias("payload"),
        _digest(payload).alias("payload_digest"),
    )


def derive(source: DataFrame) -> DataFrame:
    """Two records for every response: its metadata and its plain text.

    Both refer to the response and carry its address, date and payload digest; the metadata block
    quotes the response's HTTP headers and names the conversion. Each is one narrow step over the
    responses, without a shuffle. An empty payload gives an empty conversion; markup that
    never closes is kept as text. Columns: row, record_type, record_id, refers_to,
    target_uri, headers (the WARC header), block, block_digest, block_length.
    """
    text = plain_text(F.col("payload"))
    with_text = source.select("*", text.alias("text"), _urn("conversion", F.col("record_id")).alias("conversion_id"), _urn("metadata", F.col("record_id")).alias("metadata_id"))
    quoted_head = F.replace(F.rtrim(F.regexp_replace(F.col("http_headers"), r"[\r\n]+$", "")), F.lit(CRLF), F.lit(" | "))
    about = _fields(
        ("source-record-id", F.col("record_id")),
        ("source-http-headers", quoted_head),
        ("source-payload-digest", F.col("payload_digest")),
        ("source-payload-length", F.octet_length("payload")),
        ("conversion-record-id", F.col("conversion_id")),
        ("conversion-digest", _digest(F.col("text"))),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.col("metadata_id").alias("id"), F.lit("application/warc-fields").alias("content_type"), about.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.col("conversion_id").alias("id"), F.lit("text/plain").alias("content_type"), F.col("text").alias("block")),
    )
    each = with_text.select("row", "record_id", "target_uri", "date", "payload_digest", F.explode(kinds).alias("d"))
    block = F.col("d.block")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _fields(
            ("WARC-Type", F.col("d.record_type")),
            ("WARC-Record-ID", F.col("d.id")),
            ("WARC-Refers-To", F.col("record_id")),
            ("WARC-Target-URI", F.col("target_uri")),
            ("WARC-Date", F.col("date")),
            ("WARC-Source-Payload-Digest", F.col("payload_digest")),
            ("WARC-Block-Digest", _digest(block)),
            ("Content-Type", F.col("d.content_type")),
            ("Content-Length", F.octet_length(block)),
        ),
    )
    return each.select(
        "row", "d.record_type", F.col("d.id").alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri",
        head.alias("headers"), block.alias("block"), _digest(block).alias("block_digest"), F.octet_length(block).cast("long").alias("block_length"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Write derived records as gzip WARC files: the two line ends after a record are the writer's separator."""
    records.select(F.concat("headers", F.lit(CRLF), "block")).write.option("compression", "gzip").option("lineSep", CRLF * 2).text(path)
