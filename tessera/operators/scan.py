"""Running aggregates over the ordered rows of a key, with no task that needs a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import stored

_PART, _AT = "scan_part__", "scan_at__"


def _total(kind: str, value: Column) -> Column:
    """The aggregate of a run of rows that a later run starts from."""
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.col(_AT)))
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "bit_xor": F.bit_xor}[kind](value)


def _local(kind: str, value: Column) -> Column:
    return F.last(value, ignorenulls=True) if kind == "last" else _total(kind, value)


def _joined(kind: str, carried: Column, own: Column) -> Column:
    """What both runs make together; either may be null."""
    both = {"sum": carried + own, "count": carried + own, "max": F.greatest(carried, own), "min": F.least(carried, own), "bit_xor": carried.bitwiseXOR(own), "last": own}[kind]
    return F.coalesce(both, own, carried)


def running(rows: DataFrame, key: list[str], order: list[str | Column], out: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add, for each name in ``out``, the aggregate (kind, value) of a row and all before it in its key.

    Kinds: sum, count, max, min, bit_xor, last (the last value that is not null). Rows are dealt by ranges of key and order, so a
    key with any share of the rows spreads over tasks; each range is folded by itself, the totals of the ranges of a key are
    folded in turn, and each range starts from what came before it. Only the first key of a range can have begun before it, so what is
    carried is at most a row for each range, and is sent to all tasks. Rows that agree in key and order follow each other in any
    order, and stay in one range. Null keys are a key.
    """
    name = {k: f"scan_value_{i}__" for i, k in enumerate(out)}
    by = [F.col(k) if isinstance(k, str) else k for k in [*key, *order]]
    valued = rows.withColumns({name[k]: v for k, (_, v) in out.items()})
    cut = valued.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({_PART: F.spark_partition_id(), _AT: F.monotonically_increasing_id()})
    held = stored(cut, "scan")  # ranges are drawn from a sample: one that is drawn again may cut elsewhere
    totals = held.groupBy(_PART, *key).agg(*[_total(kind, F.col(name[k])).alias(name[k]) for k, (kind, _) in out.items()], F.lit(1).alias("one"))
    before = Window.partitionBy(*key).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    fold = {k: F.last(name[k], ignorenulls=True) if kind == "last" else _total("sum" if kind == "count" else kind, F.col(name[k])) for k, (kind, _) in out.items()}
    prior = totals.select(_PART, *key, F.count("one").over(before).alias("ranges"), *[c.over(before).alias(name[k]) for k, c in fold.items()]).where("ranges > 0")
    carried = prior.select(F.col(_PART).alias("p__"), *[F.col(k).alias(f"k{i}__") for i, k in enumerate(key)], *[F.col(name[k]).alias(f"c_{name[k]}") for k in out])
    within = Window.partitionBy(_PART, *key).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
    own = held.withColumns({name[k]: _local(kind, F.col(name[k])).over(within) for k, (kind, _) in out.items()})
    same = F.col(_PART) == F.col("p__")
    for i, k in enumerate(key):
        same &= F.col(k).eqNullSafe(F.col(f"k{i}__"))
    met = own.join(F.broadcast(carried), same, "left")
    return met.select(*rows.columns, *[_joined(kind, F.col(f"c_{name[k]}"), F.col(name[k])).alias(k) for k, (kind, _) in out.items()])
