"""Keeping an index up to date: diffs, merges, invalidation, work lists, and checks.

Tables are immutable snapshots: each operator makes the next state of a table from the last
and the changes, and cascades are semi joins with what is still there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seekwell.functions.text import non_blank

KEY = ["project_name", "path"]
_BARS = 1000


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(project_name, path, change)`` of two listings by time and size: added, changed, removed, unchanged."""
    a = old.select(*KEY, F.struct("source_mtime_ns", "source_size_bytes").alias("was"))
    b = new.select(*KEY, F.struct("source_mtime_ns", "source_size_bytes").alias("now"))
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("now").isNull(), "removed")
        .when(F.col("was") == F.col("now"), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, KEY, "full_outer").select(*KEY, change.alias("change"))


def write_kind(old: DataFrame, new: DataFrame) -> DataFrame:
    """For listed documents: whether only time and size need an update, or the whole row.

    Same source, title and type, and either the rich content still waits or content and
    status are the same: a touch. Else an upsert.
    """
    columns = ("source_hash", "content_hash", "title", "file_type", "extraction_status")
    a = old.select(*KEY, *(F.col(c).alias(f"old_{c}") for c in columns), F.lit(True).alias("there"))
    same = [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in ("source_hash", "title", "file_type")]
    waits = (F.col("file_type") != "text") & (F.col("extraction_status") == "pending")
    alike = F.col("content_hash").eqNullSafe(F.col("old_content_hash")) & F.col("extraction_status").eqNullSafe(
        F.col("old_extraction_status")
    )
    touch = F.col("there").isNotNull() & same[0] & same[1] & same[2] & (waits | alike)
    return new.join(a, KEY, "left").select(*KEY, F.when(touch, "touch").otherwise("upsert").alias("write"))


def applied(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` as they are stored: of one that only touches the old row, its time and size."""
    kinds = write_kind(old, new)
    was = old.select(*KEY, *(F.col(c).alias(f"_{c}") for c in ("content_hash", "extraction_status", "updated_at")))
    joined = new.join(kinds, KEY).join(was, KEY, "left")
    touch = F.col("write") == "touch"
    kept = {c: F.when(touch, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("content_hash", "extraction_status", "updated_at")}
    return joined.select(*(kept.get(c, F.col(c)).alias(c) for c in new.columns))


def changes(old: DataFrame | None, new: DataFrame, key: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """Between two states of a table: keys whose row is gone or another one, and rows that are new or another one."""
    if old is None:
        return None, new
    same = F.sha2(F.to_json(F.struct(*(F.col(c) for c in new.columns)), {"ignoreNullFields": "false"}), 256).alias("_row")
    was, now = (t.select(*key, same) for t in (old.select(new.columns), new))
    gone = was.join(now, [*key, "_row"], "left_anti").select(key)
    fresh = new.withColumn("_row", same).join(was, [*key, "_row"], "left_anti").select(new.columns)
    return gone, fresh


def merged(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` with another key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def without(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def live_contents(contents: DataFrame, docs: DataFrame) -> DataFrame:
    """Contents that some document has; chunks and embeddings follow by the same semi join."""
    return contents.join(docs.select("content_hash").distinct(), "content_hash", "left_semi")


def live_lexical(lexical: DataFrame, docs: DataFrame) -> DataFrame:
    """Token rows whose document is still ready, with the same content and title."""
    key = [*KEY, "content_hash", "title"]
    return lexical.join(docs.where("extraction_status = 'ready'").select(key), key, "left_semi").select(lexical.columns)


def missing_lexical(docs: DataFrame, lexical: DataFrame) -> DataFrame:
    """Ready documents that the token index lacks."""
    return docs.where("extraction_status = 'ready'").join(lexical.select(KEY), KEY, "left_anti")


def chunk_work(docs: DataFrame, contents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct contents of ready documents that have text but no chunks."""
    wanted = docs.where("extraction_status = 'ready'").select("content_hash").distinct()
    live = contents.where(non_blank(F.col("body"))).join(wanted, "content_hash", "left_semi")
    return live.join(chunks.select("content_hash").distinct(), "content_hash", "left_anti")


def embedding_work(docs: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks of ready documents without an embedding of that document and content."""
    key = ["document_id", "content_hash", "chunk_index"]
    pairs = docs.where("extraction_status = 'ready'").select("document_id", "project_name", "content_hash").join(
        chunks.select("content_hash", "chunk_index"), "content_hash"
    )
    return pairs.join(embeddings.select(key), key, "left_anti")


def invalidated(docs: DataFrame, file_types: list[str]) -> DataFrame:
    """Extracted documents of the types wait again: pending, without content."""
    hit = F.col("file_type").isin(file_types) & F.col("extraction_status").isin("ready", "failed") & F.col("source_hash").isNotNull()
    return docs.withColumn("content_hash", F.when(~hit, F.col("content_hash"))).withColumn(
        "extraction_status", F.when(hit, "pending").otherwise(F.col("extraction_status"))
    )


def status(source_hash: Column, body: Column) -> Column:
    """Text is ready; a source without text waits; without a source it failed."""
    return F.when(body.isNotNull(), "ready").when(source_hash.isNotNull(), "pending").otherwise("failed")


IDENTITY = ["cache_key", "operation", "recipe_id", "input_hash"]


def cache_hits(work: DataFrame, cache: DataFrame) -> DataFrame:
    """Work with the ``payload`` of the row that has its key and all that the key was made of."""
    return work.join(cache.select(*IDENTITY, "payload").dropDuplicates(IDENTITY), IDENTITY)


def cache_misses(work: DataFrame, cache: DataFrame) -> DataFrame:
    return work.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def evicted(cache: DataFrame, cap: int, keep: int, cheap: list[str]) -> DataFrame:
    """Beyond ``cap`` rows, the rows that go so that ``keep`` stay: cheap ones first, then the oldest, then by key.

    The cut is found on histograms of time with at most ``_BARS`` bars, of which the one at the cut
    is looked at more closely until it is one second; only rows of that second are put in order.
    A null time is the oldest.
    """
    rows = cache.withColumn("_cheap", F.coalesce(F.col("operation").isin(cheap), F.lit(False))).withColumn(
        "_time", F.coalesce(F.col("created_at"), F.lit(-(1 << 62)))
    )
    sides = {r["_cheap"]: r for r in rows.groupBy("_cheap").agg(F.count("*").alias("n"), F.min("_time").alias("low"), F.max("_time").alias("high")).collect()}
    total = sum(r.n for r in sides.values())
    if total <= cap or total <= keep:
        return cache.limit(0)
    side, excess = True, total - keep
    if True not in sides or excess > sides[True].n:
        side, excess = False, excess - (sides[True].n if True in sides else 0)
    low, high = sides[side].low, sides[side].high
    while low < high:
        width = -(-(high - low + 1) // _BARS)
        bar = F.floor((F.col("_time") - low) / width) if width > 1 else F.col("_time") - low
        bars = rows.where((F.col("_cheap") == side) & F.col("_time").between(low, high)).groupBy(bar.cast("long").alias("bar")).count()
        for r in sorted(bars.collect()):
            if r["count"] >= excess:
                low, high = low + r.bar * width, min(high, low + (r.bar + 1) * width - 1)
                break
            excess -= r["count"]
    before = (F.col("_cheap") == side) & (F.col("_time") < low)
    whole = rows.where(before if side else F.col("_cheap") | before)
    ordered = F.row_number().over(W.partitionBy("_cheap", "_time").orderBy("cache_key"))
    part = rows.where((F.col("_cheap") == side) & (F.col("_time") == low)).withColumn("_i", ordered).where(F.col("_i") <= excess).drop("_i")
    return whole.unionByName(part).drop("_cheap", "_time")


def violations(docs: DataFrame) -> DataFrame:
    """A row for each document and broken rule."""
    sha = "^[0-9a-f]{64}$"
    rules = [
        ("content_hash", F.col("content_hash").isNotNull() & ~F.col("content_hash").rlike(sha)),
        ("source_hash", F.col("source_hash").isNotNull() & ~F.col("source_hash").rlike(sha)),
        ("path", F.col("path").isNull() | (F.col("path") == "") | F.col("path").startswith("/")),
        ("project", F.col("project_name").isNull() | (F.col("project_name") == "")),
        ("size", F.col("source_size_bytes") < 0),
        ("file_type", ~F.col("file_type").isin("text", "pdf", "image", "audio", "video", "other")),
        ("status", ~F.col("extraction_status").isin("ready", "pending", "failed")),
        ("ready_content", (F.col("extraction_status") == "ready") != F.col("content_hash").isNotNull()),
    ]
    broken = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules)))
    return docs.select(*KEY, F.explode(broken).alias("rule"))


def chunk_violations(chunks: DataFrame) -> DataFrame:
    """``(content_hash, rule)``: offsets out of order, indexes with gaps or twice."""
    by_content = chunks.groupBy("content_hash").agg(
        F.count_if((F.col("char_start_offset") < 0) | (F.col("char_end_offset") < F.col("char_start_offset"))).alias("bad"),
        F.count("*").alias("n"), F.count_distinct("chunk_index").alias("k"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"),
    )
    rules = [("offsets", F.col("bad") > 0), ("repeated", F.col("k") < F.col("n")), ("gaps", (F.col("low") != 0) | (F.col("high") - F.col("low") + 1 != F.col("k")))]
    return by_content.select("content_hash", F.explode(F.array_compact(F.array(*(F.when(t, F.lit(name)) for name, t in rules)))).alias("rule"))
