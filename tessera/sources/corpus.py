"""The corpus as files, chunks and queries, and readers for the exchange formats of retrieval benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Tokens in a chunk and tokens that neighbours share.
CHUNK, OVERLAP = 128, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: path, title (the first five words), content, size."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"),
        T.truncate_words(F.coalesce("text", F.lit("")), 5).alias("title"),
        F.col("text").alias("content"),
        F.col("n_chars").alias("size"),
        "lang",
        "source",
    )


def chunks(notes: DataFrame, most: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Token windows of each note; notes without tokens have none."""
    cut = notes.withColumn("toks", T.tokens(F.col("content"))).where(F.size("toks") > 0)
    each = cut.select("file_path", "title", F.explode(T.token_windows(F.col("toks"), most, overlap)).alias("w"))
    return each.select(
        F.concat("file_path", F.lit("#"), F.col("w.idx").cast("string")).alias("chunk_id"),
        "file_path",
        "title",
        F.col("w.idx").alias("chunk_index"),
        F.col("w.tokens").alias("tokens"),
        F.size("w.tokens").alias("dl"),
    )


def index_entries(notes: DataFrame) -> DataFrame:
    """What the lexical index holds: content chunks and one title entry per note."""
    titles = notes.select(
        F.concat("file_path", F.lit("#title")).alias("chunk_id"), "file_path", "title", F.lit(None).cast("int").alias("chunk_index"),
        T.tokens(F.col("title")).alias("tokens"),
    )
    titles = titles.withColumn("dl", F.size("tokens")).where("dl > 0")
    return chunks(notes).withColumn("is_title", F.lit(False)).unionByName(titles.withColumn("is_title", F.lit(True)))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are skipped."""
    return tolerant_json(spark.read.text(path), schema)


def tolerant_json(lines: DataFrame, schema: str) -> DataFrame:
    """Parse ``value``; a line that fails is tried again without control characters, and skipped if that fails."""
    probe = F.try_parse_json("value").isNotNull()
    good = F.when(probe, F.col("value")).otherwise(T.strip_controls(F.col("value")))
    rows = lines.where(F.trim("value") != "").select(good.alias("value"))
    return rows.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("row")).select("row.*")


def numbered(lines: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """Lines ``offset`` to ``offset + limit`` of the non-blank ones in the given order."""
    return lines.where(F.trim("value") != "").orderBy(order).offset(offset).limit(limit)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated judgements with a header; rows of at least three columns, relevance above 0."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    q, d, s = rows.columns[:3]
    return rows.select(F.col(f"`{q}`").alias("query_id"), F.col(f"`{d}`").alias("doc_id"), F.col(f"`{s}`").try_cast("int").alias("relevance")).where("relevance > 0")


def parse_run(lines: DataFrame) -> DataFrame:
    """Lines ``query Q0 doc rank score run``; those with fewer than six fields are skipped."""
    f = F.split(F.trim("value"), r"\s+")
    good = lines.select(f.alias("f")).where(F.size("f") >= 6)
    return good.select(F.col("f")[0].alias("query_id"), F.col("f")[2].alias("doc_id"), F.col("f")[3].try_cast("int").alias("rank"), F.col("f")[4].try_cast("double").alias("score"), F.col("f")[5].alias("run_id"))


def run_lines(results: DataFrame, run_id: str) -> DataFrame:
    """The same lines for results (query_id, doc_id, rank, score)."""
    return results.select(F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("Q0"), "doc_id", F.col("rank").cast("string"), F.format_string("%.6f", "score"), F.lit(run_id)).alias("value"))
