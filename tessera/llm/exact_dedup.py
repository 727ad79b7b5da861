"""Exact deduplication by progressive refinement, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, lower_az, packed, quoted, stored, without

#: Leading characters that the second refinement hashes.
PREFIX_CHARS = 256


def exact_dedup(docs: DataFrame, carry: list[str] | None = None, digest: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mark each row with the row of equal text that stays.

    Texts are equal when identical after lower-casing A-Z only; a null text counts as
    empty, a text of any length is hashed whole. Of equal texts the row with the largest id stays (a null id is smaller than
    any other); rows that share text and id are repeated rows, of which one stays.

    Refinement: rows are grouped by byte length; those whose length others have too by length and the hash of their first
    ``PREFIX_CHARS`` characters; and only rows whose group has company still get the SHA-256 of their whole text (``digest``, its hex
    form, where the caller has it anyway). The others are unique already. Each level is an aggregation that is combined before its shuffle. Its surviving
    groups are written and counted; up to ``common.ROWS_SENT`` of them go to the next scan as a broadcast, more
    meet it in a shuffled join, whose hot groups AQE splits.

    Returns the ``carry`` columns (default: all of ``docs``; same-named ones are
    replaced) with keep_id, group_size and kept. An empty table gives an empty result.
    """
    carry = [c for c in (carry or docs.columns) if c in without(docs, "keep_id", "group_size", "kept")]
    text = F.coalesce(*quoted(text_col), F.lit(""))
    base = docs.select(
        packed(docs.select(*quoted(*carry))).alias("row"),
        quoted(id_col)[0].alias("id"),
        (F.sha2(lower_az(text), 256) if digest is None else digest).alias("digest"),
        F.octet_length(text).alias("len"),
        F.xxhash64(lower_az(F.substring(text, 1, PREFIX_CHARS))).alias("prefix"),
    )
    shared = lambda rows, *level: stored(rows.groupBy(*level).agg(F.count("*").alias("n")).where("n > 1").select(*level), "exact-groups")
    lengths = shared(base, "len")
    prefixes = shared(base.join(bounded(lengths), "len", "left_semi"), "len", "prefix")
    marked = stored(
        base.join(bounded(prefixes.withColumn("hit", F.lit(True))), ["len", "prefix"], "left").select(
            "row", "id", F.when(F.col("hit"), F.unhex("digest")).alias("full"), F.monotonically_increasing_id().alias("rid")
        ),
        "exact",
    )
    alone = marked.where("full is null").select(
        "row.*", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    rest = marked.where("full is not null")
    # The groups are stored so that AQE can split the reads of a hot one in the join below.
    groups = stored(
        rest.groupBy("full").agg(F.max(F.struct("id", (-F.col("rid")).alias("rid"))).alias("best"), F.count("*").alias("n")),
        "exact-groups",
    )
    linked = rest.join(groups, "full").select(
        "row.*",
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("rid") == -F.col("best.rid")).alias("kept"),
    )
    return alone.unionByName(linked)
