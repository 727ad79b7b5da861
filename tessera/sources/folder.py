"""Notes and extracted pages in a folder of any file system that Spark reads, at rest and as a stream.

Spark's file sources pass over files without bytes; these have no chunks either, so to an index such a file is as good as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType, StringType, TimestampType

from tessera.functions import text as T
from tessera.operators import bm25, filters, sequences
from tessera.sources.files import Folder

_FILE = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])
#: Files that a read may name one by one; beyond that the whole folder is read and the others are left out by a join.
NAMED = 4096


def _root(spark: SparkSession, root: str) -> str:
    folder = Folder(spark, root)
    return folder._fs.makeQualified(folder.root).toString().rstrip("/") + "/"


def _relative(path: Column, base: str) -> Column:
    """The path below the folder; the scheme may be written with one slash or three."""
    bare = lambda c: F.regexp_replace(c, "^([a-z0-9+.-]+):/+", "$1:/")
    return F.url_decode(F.replace(F.substring(bare(path), F.char_length(bare(F.lit(base))) + 1, F.char_length(path)), F.lit("+"), F.lit("%2B")))


def _read(spark: SparkSession, root: str, stream: bool, paths: list[str] | None = None) -> DataFrame:
    source = (spark.readStream if stream else spark.read).format("binaryFile").option("recursiveFileLookup", "true").schema(_FILE)
    return source.load(paths if paths is not None else root)


def _wanted(path: Column, root_path: str, excluded: list[str]) -> Column:
    out = filters.indexable(path) & filters.under_root(path, root_path)
    for pattern in excluded:
        out = out & ~filters.excluded(path, pattern)
    return out


def listing(spark: SparkSession, root: str, root_path: str = "", excluded: list[str] | None = None, stream: bool = False) -> DataFrame:
    """(file_path, mtime, size) of the files that an index takes: by extension, below ``root_path``, by none of the ``excluded`` patterns. No file is opened.

    mtime is in milliseconds; paths are relative to ``root``.
    """
    each = _read(spark, root, stream).select(_relative(F.col("path"), _root(spark, root)).alias("file_path"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return each.where(_wanted(F.col("file_path"), root_path, excluded or []))


def _titled(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")


def notes(spark: SparkSession, root: str, root_path: str = "", excluded: list[str] | None = None, only: DataFrame | None = None, stream: bool = False) -> DataFrame:
    """(file_path, title, content, mtime, size) of the Markdown files that ``listing`` names; the title is the file's name, bytes that are no UTF-8 become U+FFFD.

    ``only`` (file_path) limits what is opened, as a sync does that knows what changed: up to ``NAMED`` files are read by name.
    """
    base, paths = _root(spark, root), None
    if only is not None:
        named = [r["file_path"] for r in only.select("file_path").distinct().limit(NAMED + 1).collect()]
        paths = [base + p for p in named] if len(named) <= NAMED else None
        if not named:
            return notes(spark, root, root_path, excluded).limit(0)
    each = _read(spark, root, stream, paths).select(
        _relative(F.col("path"), base).alias("file_path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        F.unix_millis("modificationTime").alias("mtime"),
        F.col("length").alias("size"),
    )
    kept = each.where(_wanted(F.col("file_path"), root_path, excluded or []) & F.lower("file_path").endswith(".md"))
    if only is not None and paths is None:
        kept = kept.join(bm25.few(only.select("file_path"), NAMED), "file_path", "left_semi") if only.count() <= bm25.ROWS_SENT else kept.join(only.select("file_path"), "file_path", "left_semi")
    return kept.select("file_path", _titled(F.col("file_path")).alias("title"), "content", "mtime", "size")


def pages(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, page, text, start) of extracted pages: files ``<document>/<number>.txt``, normalised, with the place where each starts in the text of its document."""
    each = _read(spark, root, False).select(_relative(F.col("path"), _root(spark, root)).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("raw"))
    part = lambda i: F.regexp_extract("path", r"^(.+)/(\d+)\.txt$", i)
    found = each.where(part(1) != "").select(part(1).alias("file_path"), part(2).cast("int").alias("page"), T.normalised(F.col("raw")).alias("text"))
    return sequences.offsets(found, "file_path", ["page"], F.char_length("text"), "start").select("file_path", "page", "text", "start")


def documents_of(each: DataFrame) -> DataFrame:
    """(file_path, content, n_pages) of ``pages``: a document's pages joined by line ends."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"])
    return each.groupBy("file_path").agg(F.array_join(parts, "\n").alias("content"), F.count("*").alias("n_pages"))
