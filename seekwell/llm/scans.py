"""Ranks and running totals within groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seekwell.llm.common import written

#: Positions of one window of a running total, as a power of two.
BLOCK_BITS = 12


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``pos``, the number of a row in its group from 0, and ``n``, the group's rows.

    Rows are dealt by ranges of group and order, so that a large group goes over many parts; a
    part's rows are numbered there, and go on from where the parts before it end. Nulls come
    first and are a group of their own; rows that ``order`` doesn't tell apart get any of
    their numbers, and are still dealt over several parts. The result is written once.
    """
    by = [*group, *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = written(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    names = [f"_g{i}" for i in range(len(group))]
    pieces = dealt.groupBy(F.col("_part").alias("_p"), *(F.col(g).alias(n) for g, n in zip(group, names, strict=True))).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_many")
    )
    if not group:
        pieces = pieces.withColumn("_g", F.lit(0))
    whole = W.partitionBy(*(names or ["_g"]))
    before = whole.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    known = pieces.select(
        "_p", *names, "_first", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_before"), F.sum("_many").over(whole).alias("n")
    )
    same = F.col("_part") == F.col("_p")
    for g, name in zip(group, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(name))
    pos = (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos")
    return dealt.join(known, same).select(*rows.columns, pos, "n")


def running(rows: DataFrame, group: list[str], pos: str, totals: dict[str, Column], plus=F.sum, join=lambda a, b: a + b) -> DataFrame:
    """Adds totals of the rows of a group up to and with each one; ``pos`` numbers them from 0.

    A window holds the rows of a block of numbers; the totals of the blocks before are added.
    ``plus`` is the aggregate and ``join`` adds two of its results. ``group`` columns aren't null.
    """
    keys = [*group, "_block"]
    blocked = rows.withColumn("_block", F.shiftright(pos, BLOCK_BITS))
    inside = W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    sums = blocked.groupBy(*keys).agg(*(plus(c).alias(f"_{name}") for name, c in totals.items()))
    before = W.partitionBy(*(group or [F.lit(0)])).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, *(plus(f"_{name}").over(before).alias(f"_{name}") for name in totals))
    local = blocked.select(*rows.columns, "_block", *(plus(c).over(inside).alias(name) for name, c in totals.items()))
    whole = {name: F.when(F.col(f"_{name}").isNull(), F.col(name)).otherwise(join(F.col(name), F.col(f"_{name}"))) for name in totals}
    return local.join(offsets, keys).select(*rows.columns, *(c.alias(name) for name, c in whole.items()))
