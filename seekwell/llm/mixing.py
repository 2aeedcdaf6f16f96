"""Mixing sources to target weights by hash thresholds.

Every row has a 60-bit hash of its id and text. What a source gives beyond whole repetitions is a
budget of words; the rows with the smallest hashes fill it. Of rows that are equal so many are taken as
come nearest to it. The threshold is found by
histograms: words by source and by the next 12 bits of the hash, a running sum over at
most 4096 buckets, and then the same within the one bucket where the budget ends, five
times at most. Rows are filtered by the threshold; only the equal ones at it are numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seekwell.llm.common import read, written
from seekwell.llm.scans import ranked

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
_BITS, _LEVELS = 12, 5
#: A table of sources up to this many rows is broadcast; beyond, it is joined by shuffle.
_BROADCAST_SOURCES = 100_000

_SIZE = r"regexp_count(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_HASH = "cast(conv(substring(md5(concat(coalesce(cast(doc_id AS string), ''), ':', coalesce(text, ''))), 1, 15), 16, 10) AS bigint)"


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes(source, size)`` to ``(source, rank, source_size, target)``, one row a source.

    Sources are ranked by code point, null last; their weights repeat 5, 2, 1. A target is
    weight times the level at which all targets, each cut at twice its source's size, add
    up to the share of all sizes. With sources in order of the level that fills them, the
    level is the first that the next source's own doesn't exceed. An empty table has none.
    """
    least = F.array([F.lit(w) for w in WEIGHTS])
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("full_at", "rank").rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", F.element_at(least, (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
        .withColumn("full_at", MOST_REPEATS * F.col("source_size") / F.col("weight"))
    )
    levels = (
        ranked.withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("full_size", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("full_weight", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn(
            "level",
            (SHARE * F.col("all_size") - MOST_REPEATS * F.col("full_size"))
            / (F.col("all_weight") - F.col("full_weight")),
        )
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level")))
                    .over(everything)["level"])
    )
    return levels.select(
        "source",
        "rank",
        "source_size",
        F.least(F.col("level") * F.col("weight"), (MOST_REPEATS * F.col("source_size")).cast("double")).alias("target"),
    )


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows(rank, size, h)`` and ``targets`` to ``(rank, times, edge, at_edge)``.

    All rows of a source are taken ``times`` times; those with a hash below ``edge``, and ``at_edge`` of
    those at it, once more. At the edge the count nearest to the budget is chosen, the smaller of two.
    """
    start = targets.select(
        "rank",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("times"),
        "source_size",
        "target",
    ).select("rank", "times", (F.col("target") - F.col("times") * F.col("source_size")).alias("need"))
    zero = F.lit(0).cast("long")
    state = start.withColumns({"prefix": zero, "last": zero, "equal": zero})
    for level in range(1, _LEVELS + 1):
        left = _BITS * (_LEVELS - level)
        inside = rows
        if level > 1:
            held = F.shiftright("h", left + _BITS) == F.col("prefix")
            inside = rows.join(state.select("rank", "prefix"), "rank").where(held)
        sums = inside.groupBy("rank", F.shiftright("h", left).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("equal"))
        run = sums.withColumn(
            "upto", F.sum("words").over(W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        )
        over = run.join(state.select("rank", "need"), "rank").where("upto > need")
        first = over.groupBy("rank").agg(F.min(F.struct("bucket", "words", "upto", "equal")).alias("e"))
        state = written(
            state.join(first, "rank", "left").select(
                "rank",
                "times",
                F.when(F.col("e").isNull(), F.col("need")).otherwise(F.col("need") - (F.col("e.upto") - F.col("e.words"))).alias("need"),
                # a source whose rows all fit has no edge: nothing lies beyond its last bucket
                F.coalesce("e.bucket", F.lit((1 << (60 - left)) - 1)).alias("prefix"),
                F.coalesce("e.words", F.lit(0)).cast("long").alias("last"),
                F.coalesce("e.equal", F.lit(0)).cast("long").alias("equal"),
            )
        )
    nearest = F.ceil(F.col("need") * F.col("equal") / F.col("last") - 0.5).cast("long")
    return state.select("rank", "times", F.col("prefix").alias("edge"), F.when(F.col("last") > 0, nearest).otherwise(0).alias("at_edge"))


def _planned(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``taken`` to ``rows(source, size, h, ...)``.

    The plan comes from ``known(source, size, h)``: the same rows, written before.
    """
    targets = written(source_targets(known))
    few = targets.count() <= _BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda x: x)

    def planned(df: DataFrame, plan: DataFrame) -> DataFrame:
        other = plan.withColumnRenamed("source", "_source")
        return df.join(hint(other), df["source"].eqNullSafe(other["_source"])).drop("_source")

    edges = written(thresholds(planned(known, targets.select("source", "rank")).select("rank", "size", "h"), targets))
    every = planned(rows, targets.join(edges, "rank"))
    off = every.where(F.col("h") != F.col("edge")).withColumn("more", F.col("h") < F.col("edge"))
    order = F.to_json("row") if "row" in rows.columns else F.lit("")
    equal = ranked(every.where(F.col("h") == F.col("edge")).withColumn("_order", order), ["rank"], ["_order"]).drop("_order")
    whole = off.unionByName(equal.withColumn("more", F.col("pos") < F.col("at_edge")).drop("pos", "n"))
    taken = F.col("size") * (F.col("times") + F.col("more").cast("int"))
    return whole.withColumn("taken", taken.cast("long")).drop("rank", "times", "edge", "at_edge", "more")


def mixed(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` to ``(doc_id, size, source_size, target, taken)``.

    A row each, repeated rows included, of which as many are taken as the target asks for. Size is
    the number of words, zero for null. A row's hash is of its id, null as the empty string, and its text; a null source is
    a source. ``taken`` is a multiple of the size, two at most; rows without words take 0.
    """
    sizes = docs.select("doc_id", "source", F.expr(_SIZE).cast("long").alias("size"), F.expr(_HASH).alias("h"))
    rows = written(sizes)
    return _planned(rows, rows).select("doc_id", "size", "source_size", "target", "taken")


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with the columns of ``docs``.

    Rows without words are not taken. Texts are not shuffled.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select("source", F.expr(_SIZE).cast("long").alias("size"), F.expr(_HASH).alias("h"), row)
    taken = _planned(rows, written(rows.drop("row"))).where("taken > 0")
    return taken.select("row", F.explode(F.expr("sequence(1, cast(taken div size AS int))"))).select("row.*")


def op8_mix_hash_threshold(spark, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
f AS (SELECT *, 2 * source_size::DOUBLE / weight AS full_at FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - 2 * coalesce(sum(source_size) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM f),
t AS (
  SELECT source, rank, source_size,
         least((SELECT level FROM l WHERE level <= full_at ORDER BY full_at, rank LIMIT 1) * weight, (2 * source_size)::DOUBLE) AS target
  FROM l),
n AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
c AS (
  SELECT rank, h, sum(size) AS words, count(*) AS equal, sum(sum(size)) OVER (PARTITION BY rank ORDER BY h) AS upto
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source GROUP BY rank, h),
e AS (
  SELECT n.rank, min(h) AS edge, arg_min(words, h) AS words, arg_min(upto, h) AS upto, arg_min(equal, h) AS equal
  FROM n JOIN c ON c.rank = n.rank AND c.upto > n.target - n.times * n.source_size GROUP BY n.rank)
SELECT d.doc_id, d.size::BIGINT AS size, n.source_size, n.target,
       (d.size * (n.times + CASE
          WHEN e.edge IS NULL THEN CASE WHEN n.target - n.times * n.source_size > 0 THEN 1 ELSE 0 END
          WHEN d.h < e.edge THEN 1
          WHEN d.h = e.edge AND d.k <= ceil((n.target - n.times * n.source_size - (e.upto - e.words)) * e.equal / e.words - 0.5::DOUBLE) THEN 1
          ELSE 0 END))::BIGINT AS taken
FROM (SELECT *, row_number() OVER (PARTITION BY source, h) AS k FROM d) d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN e ON e.rank = n.rank
"""
