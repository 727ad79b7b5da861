"""Corpus preparation: deduplication, sampling, merging of chunks into articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(key: Column, seed: int) -> Column:
    """An order that looks random and is the same in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(seeded(F.col(key), seed), key).limit(n)


def stratified(rows: DataFrame, key: str, stratum: Column, shares: dict[str, float], n: int, seed: int = 42) -> DataFrame:
    """Floor shares of n per stratum; the last stratum takes what is left. A short one gives all it has."""
    names = list(shares)
    sizes = {s: int(n * shares[s]) for s in names[:-1]}
    sizes[names[-1]] = n - sum(sizes.values())
    quota = F.coalesce(*[F.when(F.col("stratum") == s, F.lit(k)) for s, k in sizes.items()])
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(seeded(F.col(key), seed), key))
    return rows.withColumn("stratum", stratum).where(F.col("stratum").isin(*names)).withColumn("place", place).where(F.col("place") <= quota).drop("place")


def capped(rows: DataFrame, required: DataFrame, key: str, most: int) -> DataFrame:
    """All required rows, and others in key order until ``most``; required ones are never cut."""
    must = rows.join(required.select(key).distinct(), key, "left_semi").withColumn("required", F.lit(True))
    other = rows.join(required.select(key).distinct(), key, "left_anti").withColumn("required", F.lit(False))
    n = must.count()
    return must.unionByName(other.orderBy(key).limit(max(0, most - n)))


def first_by_url(pages: DataFrame, address: Column | None = None) -> DataFrame:
    """One page per address (the whole url, or the form that ``address`` makes of it), the first id; blank ones are dropped. Ids are dense, in that order."""
    url = F.col("url") if address is None else address
    kept = pages.where(F.trim(F.coalesce(url, F.lit(""))) != "").groupBy(url.alias("url")).agg(F.min("page_id").alias("page_id"))
    # Dense ids: counts per id range, then places within a range, so no task sorts everything.
    block = F.floor(F.col("page_id") / 4096)
    counts = kept.groupBy(block.alias("block")).count()
    before = counts.select("block", (F.sum("count").over(Window.orderBy("block")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("page_id"))
    return kept.withColumn("block", block).withColumn("place", place).join(before, "block").select("url", "page_id", (F.col("before") + F.col("place") - 1).alias("doc_no"))


def merge_articles(chunks: DataFrame) -> DataFrame:
    """(file_path, title, text, n_chunks) of chunks (file_path, chunk_index, title, text), in numeric order."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.groupBy("file_path").agg(
        F.min_by("title", "chunk_index").alias("title"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"), F.count("*").alias("n_chunks")
    )


def length_statistics(rows: DataFrame, *lengths: str) -> DataFrame:
    """Totals and rounded means, 0 for no rows."""
    out = [F.count("*").alias("n")]
    for c in lengths:
        out += [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"sum_{c}"), F.floor(F.coalesce(F.avg(c), F.lit(0.0)) + 0.5).cast("long").alias(f"avg_{c}")]
    return rows.agg(*out)


def first_by_id(rows: DataFrame, id_col: str, order: str) -> DataFrame:
    """One row per id, the least by ``order``; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (id_col, order)]
    return rows.groupBy(id_col).agg(F.min(F.struct(order, *rest)).alias("first")).select(id_col, *[F.col(f"first.{c}").alias(c) for c in rows.columns if c != id_col])
