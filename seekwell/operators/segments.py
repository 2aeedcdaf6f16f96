"""Rows kept in segments: what is new goes into one of its own, what is gone into marks beside it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A segment joins the one before it once it and all behind have a share of its rows that this many times make it up.
FAN = 4


@dataclass
class Segment:
    """``rows`` of some documents, and ``gone``: keys whose rows in earlier segments hold no more."""

    rows: DataFrame
    gone: DataFrame | None = None


def live(segments: list[Segment], key: list[str]) -> DataFrame:
    """The rows that hold, oldest segment first. A filter on rows reaches the scan of each segment.

    A key that is gone and back has its rows in the segment that says so, or in a later one.
    """
    marks = [s.gone.select(*key, F.lit(i).alias("_dead")) for i, s in enumerate(segments) if i and s.gone is not None]
    rows = [s.rows.withColumn("_seq", F.lit(i)) for i, s in enumerate(segments)]
    whole = reduce(DataFrame.unionByName, rows)
    if not marks:
        return whole.drop("_seq")
    last = reduce(DataFrame.unionByName, marks).groupBy(*key).agg(F.max("_dead").alias("_dead"))
    return whole.join(last, key, "left").where("_dead IS NULL OR _seq >= _dead").select(segments[0].rows.columns)


def marks(segments: list[Segment], key: list[str]) -> DataFrame | None:
    """Keys that some segments say are gone."""
    own = [s.gone.select(*key) for s in segments if s.gone is not None]
    return reduce(DataFrame.unionByName, own).distinct() if own else None


def tail(sizes: list[int], fan: int = FAN) -> int:
    """Number of the first of the last segments that should be one: sizes fall by ``fan`` at least from one to the next.

    So there are about as many segments as the logarithm of the rows, and a row is written anew as often.
    """
    start, total = len(sizes) - 1, sizes[-1]
    while start and total * fan >= sizes[start - 1]:
        start -= 1
        total += sizes[start]
    return start
