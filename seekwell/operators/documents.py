"""Looking documents up, by id, path, prefix or glob, and cutting their bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekwell.functions.names import doc_id, glob_regex
from seekwell.functions.text import lines


def by_prefix(docs: DataFrame, prefix: str) -> DataFrame:
    """Documents at or below a path; an empty prefix has all. Characters are literal."""
    if not prefix:
        return docs
    return docs.where((F.col("path") == prefix) | F.col("path").startswith(prefix.rstrip("/") + "/"))


def by_glob(docs: DataFrame, glob: str) -> DataFrame:
    return docs.where(F.col("path").rlike(glob_regex(glob)))


def by_doc_id(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents whose short id is among ``wanted(id)``, in any case; an id may have several."""
    ids = wanted.select(F.lower("id").alias("id")).distinct()
    return docs.withColumn("id", doc_id(F.col("content_hash"))).join(ids, "id", "left_semi")


def guarded_body(body: Column, most: int) -> Column:
    """The body if it has up to ``most`` bytes, else null."""
    return F.when(F.octet_length(body) <= most, body)


def line_range(body: Column, start: int, count: int | None) -> Column:
    """Lines from ``start``, counted from 1, ``count`` at most, each with a line end."""
    rows = lines(body)
    picked = F.slice(rows, start, count if count is not None else F.size(rows))
    return F.when(F.size(picked) > 0, F.concat(F.array_join(picked, "\n"), F.lit("\n"))).otherwise("")
