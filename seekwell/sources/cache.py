"""Results of models, kept across workspaces: asked by what made them and from what, never needed."""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekwell.functions.names import EngineError
from seekwell.operators import maintenance
from seekwell.operators.maintenance import IDENTITY
from seekwell.sources.snapshots import Workspace

#: What a store or a table that can't be read raises.
FAILURES = (PySparkException, Py4JJavaError, ValueError)
NAMESPACE = ("processing-cache", "v1")
ROW = "cache_key binary, operation string, recipe_id string, input_hash string, payload binary, created_at long"


def cache_key(operation: Column, recipe: Column, input_hash: Column) -> Column:
    """SHA-256 of the parts, each after its length in bytes as four bytes."""
    parts = [*map(F.lit, NAMESPACE), operation, recipe, input_hash]
    sized = [(F.unhex(F.lpad(F.hex(F.octet_length(p)), 8, "0")), F.encode(p, "UTF-8")) for p in parts]
    return F.unhex(F.sha2(F.concat(*(x for pair in sized for x in pair)), 256))


def identified(work: DataFrame, operation: Column, recipe: Column, input_hash: Column) -> DataFrame:
    """Work with what names its result: the key and all that it is made of."""
    own = work.withColumns({"operation": operation, "recipe_id": recipe, "input_hash": input_hash})
    return own.withColumn("cache_key", cache_key(F.col("operation"), F.col("recipe_id"), F.col("input_hash")))


class ProcessingCache:
    """A table of results in a folder that workspaces share, in buckets by key.

    A lookup reads the buckets of its keys only. A cache that can't be read has nothing, one that can't be
    written, or that another one writes, is left as it is: no failure of it fails a sync. Beyond ``cap`` rows
    those of ``cheap`` operations go first, then the oldest, until ``keep`` stay.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        cap: int = 10_000_000,
        keep: int = 9_000_000,
        cheap: tuple[str, ...] = ("embed",),
        clock: Callable[[], float] = time.time,
        bucket_rows: int = 50_000,
    ) -> None:
        self.space = Workspace(spark, path, bucket_rows)
        self.cap, self.keep, self.cheap, self.clock = cap, keep, list(cheap), clock

    def table(self) -> DataFrame | None:
        try:
            return self.space.read("cache")
        except FAILURES:
            return None

    def hits(self, work: DataFrame) -> DataFrame:
        """Identified work with the ``payload`` of the row that has its whole identity."""
        try:
            near = self.space.read("cache", work.select("cache_key"))
            found = maintenance.cache_hits(work, near) if near is not None else None
            if found is not None and not found.isEmpty():
                return found
        except FAILURES:
            pass
        return work.withColumn("payload", F.lit(None).cast("binary")).limit(0)

    def put(self, rows: DataFrame) -> bool:
        """Keep ``rows(cache_key, operation, recipe_id, input_hash, payload)`` in place of those with the same keys."""
        now = F.lit(int(self.clock())).cast("long")
        new = rows.where("payload IS NOT NULL").select(*IDENTITY, "payload", now.alias("created_at")).dropDuplicates(["cache_key"])
        try:
            with self.space.writing("cache"):
                made = self.space.building()
                new = made.step("results", new)
                if made.had("cache") is None:
                    made.whole("cache", new, ["cache_key"], self.cap)
                else:
                    made.change("cache", new.select("cache_key"), new, ["cache_key"])
                made.publish({})
                gone = maintenance.evicted(self.space.read("cache"), self.cap, self.keep, self.cheap)
                if not gone.isEmpty():
                    made = self.space.building()
                    made.change("cache", gone.select("cache_key"), new.limit(0), ["cache_key"])
                    made.publish({})
                self.space.collect()
            return True
        except (EngineError, *FAILURES):
            return False
