"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, quoted, stored, without

#: Largest rate of one draw; a higher rate is drawn as the sum of several independent draws.
LOT_RATE = 16.0
#: Terms of the inverted distribution: beyond the 80th a Poisson of rate 16 has less than 1e-26 left.
TERMS = 80
#: Hash fractions have 52 bits.
SPAN = 1 << 52
#: Weights over the sources of ``documents``: the source that holds a third of the rows is cut back, four get more.
WEIGHTS = {"src0": 0.20, "src1": 0.08, "src2": 0.08, "src3": 0.08, "src4": 0.08}
SEED = 20240613


def fraction(*parts: Column | str) -> Column:
    """A hash of the parts as a number in [0, 2**52)."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float], total: Column | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Mean repetitions per source: weight x target size / size of the source.

    One row per named source and one for all others together (null), which share the
    remaining weight in proportion to their sizes; so the table has ``len(weights) + 1``
    rows at most. A document's size is its UTF-8 bytes plus one.
    """
    if any(w < 0 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights must not be negative, nor exceed 1 together")
    rest = max(0.0, 1.0 - math.fsum(weights.values()))
    pool = F.when(quoted(source_col)[0].isin(*weights), quoted(source_col)[0])
    size = F.octet_length(F.coalesce(quoted(text_col)[0], F.lit(""))).cast("long") + 1
    sizes = docs.groupBy(pool.alias("pool")).agg(F.sum(size).alias("size"))
    share = F.coalesce(*[F.when(F.col("pool") == s, F.lit(float(w))) for s, w in weights.items()], F.lit(rest)) if weights else F.lit(rest)
    lots = F.greatest(F.lit(1.0), F.ceil(F.col("rate") / LOT_RATE).cast("double"))
    step = lambda acc, k: F.struct(
        (acc["p"] * F.col("lot_rate") / k).alias("p"),
        (acc["c"] + acc["p"] * F.col("lot_rate") / k).alias("c"),
        F.concat(acc["cdf"], F.array(acc["c"] + acc["p"] * F.col("lot_rate") / k)).alias("cdf"),
    )
    p0 = F.exp(-F.col("lot_rate"))
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("cdf")), step)["cdf"]
    return (
        sizes.withColumn("all", F.sum("size").over(Window.partitionBy()))  # over len(weights) + 1 rows at most
        .withColumn("rate", share * (total if total is not None else F.col("all")) / F.col("size"))
        .withColumn("lots", lots.cast("long"))
        .withColumn("lot_rate", F.col("rate") / lots)
        .withColumn("cdf", cdf)
    )


def mix(docs: DataFrame, weights: dict[str, float], seed: int = SEED, total: Column | None = None, partitions: int | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Repeat every document a Poisson number of times and shuffle the copies globally.

    The count inverts the Poisson distribution of the source's mean at a hash of seed and
    id, so it is the same in every run and on every layout. Rates over ``LOT_RATE`` are
    sums of independent draws, which are Poisson too; no count is capped. Copies go
    to the partition that their hashed position names and are ordered by it there,
    which is a global order without a sampling pass.

    Null texts have size one; a null source is among the unnamed ones; rows that share an
    id share its draws; a source of weight 0 yields nothing; no rows give no rows.
    Returns the columns of ``docs`` (same-named ones are replaced) with mean_copies,
    copy_no (distinct among a document's copies) and position.
    """
    added = ["mean_copies", "copy_no", "position"]
    kept = without(docs, *added)
    # At most len(weights) + 1 rows: a broadcast of proven size, so a hot source is not shuffled to one place.
    table = F.broadcast(stored(rates(docs, weights, total, source_col, text_col), "rates").select("pool", "rate", "lots", "cdf"))
    source = quoted(source_col)[0]
    rows = docs.select(packed(docs, *added).alias("row"), quoted(id_col)[0].alias("id"), F.when(source.isin(*weights), source).alias("key"))
    drawn = (
        rows.join(table, F.col("key").eqNullSafe(F.col("pool")))
        .select("row", "id", "rate", "cdf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"))
        .withColumn("u", (fraction(f"{seed}", F.col("id"), F.col("lot")) + 0.5) / float(SPAN))
        .withColumn("n", F.size(F.filter("cdf", lambda c: c <= F.col("u"))))
        .where("n > 0")
        .select("row", "id", "rate", "lot", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
        .withColumn("position", fraction(f"{seed}", F.lit("place"), F.col("id"), F.col("lot"), F.col("copy")))
    )
    spread = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = drawn.withColumn("part", F.floor(F.col("position") / float(SPAN) * spread).cast("int"))
    return (
        placed.repartitionById(spread, F.col("part"))
        .sortWithinPartitions("position")
        .select(
            *[F.col("row").getField(c).alias(c) for c in kept],
            F.col("rate").alias("mean_copies"),
            (F.col("lot") * (TERMS + 2) + F.col("copy")).cast("long").alias("copy_no"),
            "position",
        )
    )
