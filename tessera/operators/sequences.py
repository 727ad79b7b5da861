"""As-of lookups, offsets and running budgets; a key of any size spreads over tasks (``scan``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import scan


def as_of(points: DataFrame, starts: DataFrame, key: str, at: str, start: str, value: str, else_first: bool = False) -> DataFrame:
    """Each point with the value of the last start at or before it in its key (a column of that name is replaced).

    Before the first start it is null or, with ``else_first``, the value of the first start. Points and starts are laid in one order per key
    and the last start is carried along, so the cost is a sort and not a range join. Of starts at one place the largest value counts.
    """
    kept = [c for c in points.columns if c.lower() != value.lower()]
    p = points.select(F.col(key).alias("key"), F.col(at).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(starts.schema[value].dataType).alias("value"), F.struct(*[F.col(c) for c in kept]).alias("row"))
    s = starts.select(F.col(key).alias("key"), F.col(start).alias("at"), F.lit(0).alias("kind"), F.col(value).alias("value"), F.lit(None).cast(p.schema["row"].dataType).alias("row"))
    found = scan.running(p.unionByName(s), ["key"], ["at", "kind", F.asc_nulls_first("value")], {"found": ("last", F.col("value"))}).where("kind = 1")
    if else_first:
        first = s.groupBy("key", "at").agg(F.max("value").alias("value")).groupBy("key").agg(F.min_by("value", "at").alias("first"))
        found = found.join(first, "key", "left").withColumn("found", F.coalesce("found", "first"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("found").alias(value))


def offsets(parts: DataFrame, key: str, order: list[str | Column], length: Column, name: str) -> DataFrame:
    """Add ``name``: where a part starts when the parts of a key are joined by one character."""
    return scan.running(parts, [key], order, {name: ("sum", length.cast("long") + 1)}).withColumn(name, F.col(name) - length - 1)


def within_budget(rows: DataFrame, group: str, order: list[str | Column], cost: Column, budget: int) -> DataFrame:
    """Rows in order up to the first that does not fit; costs are not negative, so the running sum decides."""
    return scan.running(rows, [group], order, {"running": ("sum", cost)}).where(F.col("running") <= budget)
