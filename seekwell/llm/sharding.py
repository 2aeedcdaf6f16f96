"""Shards by extendible hashing.

The directory is a binary tree over the leading bits of a row's hash. A bucket whose rows
exceed the byte limit splits on another bit; all others stay as they are. Bytes are summed
once by cells of some more bits than an even split would need. Each task rolls up subtrees of
at most ``2 ** _LEVELS`` cells: a cell's shard is its shallowest bucket within the limit. A
subtree that is within the limit as a whole is a cell of the next, shallower round; cells
that are still too large are split alone on further bits.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.llm.common import read, written

LIMIT_BYTES = 1 << 20
_BITS = 60
#: Bits below those of an even split that the first sums have; later rounds go on by as many.
_SLACK = 6
#: Bits that a task rolls up at once.
_LEVELS = 12

_HASH = "cast(conv(substring(md5(concat(coalesce(cast(doc_id AS string), ''), ':', coalesce(text, ''))), 1, 15), 16, 10) AS bigint)"


def _cells(rows: DataFrame, level: int) -> DataFrame:
    return rows.groupBy(F.shiftright("h", _BITS - level).alias("cell")).agg(
        F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")
    )


def _rolled(cells: DataFrame, level: int, root: int, limit: int) -> DataFrame:
    """For each cell of ``level`` bits its shallowest bucket that holds, from ``root`` bits on.

    A bucket holds if its rows are within the limit, or can't be told apart by any bit. The
    depth is null if not even the cell does.
    """

    def roll(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = pdf["cell"].to_numpy(np.int64)
        sums = [pdf[c].to_numpy(np.int64) for c in ("b", "n", "lo", "hi")]
        out = pdf.assign(depth=-1, prefix=cell)
        for depth in range(level, root - 1, -1):
            inside = (cell >> (level - depth)) - (int(cell[0]) >> (level - root) << (depth - root))
            b, n = (np.zeros(1 << depth - root, np.int64) for _ in range(2))
            lo, hi = np.full(len(b), 1 << _BITS), np.full(len(b), -1)
            for at, (total, part) in zip((np.add, np.add, np.minimum, np.maximum), zip((b, n, lo, hi), sums, strict=True), strict=True):
                at.at(total, inside, part)
            holds = ((b <= limit) | (lo == hi))[inside]
            values = {"depth": depth, "prefix": cell >> (level - depth), "b": b[inside], "n": n[inside], "lo": lo[inside], "hi": hi[inside]}
            for c, v in values.items():
                out[c] = np.where(holds, v, out[c])
        return out.astype({"depth": np.int32})

    schema = "cell long, b long, n long, lo long, hi long, depth int, prefix long"
    found = cells.groupBy(F.shiftright("cell", level - root)).applyInPandas(roll, schema)
    return found.withColumn("depth", F.expr("nullif(depth, -1)"))


def _settled(rows: DataFrame, low: int, high: int, limit: int) -> tuple[list[DataFrame], DataFrame]:
    """Rows with their bucket of ``low`` to ``high`` bits, and those of cells that none holds."""
    columns, done, over = rows.columns, [], None
    cells, level = _cells(rows, high), high
    while True:
        root = max(low, level - _LEVELS)
        rolled = written(_rolled(cells, level, root, limit))
        placed = rows.join(rolled.drop("lo", "hi"), F.shiftright("h", _BITS - level) == F.col("cell"))
        up = (F.col("depth") == root) if root > low else F.lit(False)
        done.append(placed.where(F.col("depth").isNotNull() & ~up))
        if over is None:
            over = placed.where("depth IS NULL").select(columns)
        if root == low:
            return done, over
        if rolled.where(F.col("depth") == root).isEmpty():
            return done, over
        # a subtree that has split is a cell that no bucket can take in
        whole = F.max(F.coalesce(F.col("depth") == root, F.lit(False)))
        parts = {"b": limit + 1, "n": 0, "lo": 0, "hi": 1}
        cells = rolled.groupBy(F.shiftright("cell", level - root).alias("cell")).agg(*(F.when(whole, F.max(c)).otherwise(F.lit(v)).cast("long").alias(c) for c, v in parts.items()))
        rows, level = written(placed.where(up).select(columns)), root


def shards(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, n_bytes, shard, depth, shard_bytes, shard_docs, fits)``.

    ``shard`` is the bucket's leading bits, empty if all rows fit into one. A row's hash is of
    its id and text, so rows that repeat both share a shard. Only a shard of one such row or
    its repeats can exceed the limit; ``fits`` is then false. Null texts have no bytes. An
    empty table gives an empty table; other columns are ignored.
    """
    rows = written(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.expr(_HASH).alias("h")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    done, low, high = [], 0, min(_BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + _SLACK)
    while True:
        found, rows = _settled(rows, low, high, limit)
        done += found
        if high == _BITS:
            break
        rows = written(rows)
        if rows.isEmpty():
            break
        low, high = high + 1, min(_BITS, high + _SLACK)
    return reduce(DataFrame.unionByName, done).select(
        "doc_id",
        "n_bytes",
        F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')")).alias("shard"),
        "depth",
        F.col("b").alias("shard_bytes"),
        F.col("n").alias("shard_docs"),
        (F.col("b") <= limit).alias("fits"),
    )


def op6_extendible_shards(spark, sf_dir: str) -> DataFrame:
    return shards(read(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
u AS (SELECT doc_id, n_bytes, h, d.depth::INTEGER AS depth, (h >> (60 - d.depth))::BIGINT AS prefix FROM r, range(0, 61) AS d(depth)),
b AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs FROM u
  GROUP BY depth, prefix HAVING sum(n_bytes) <= {LIMIT_BYTES} OR min(h) = max(h)),
m AS (
  SELECT u.doc_id, u.n_bytes, u.h, min(u.depth) AS depth FROM u JOIN b ON b.depth = u.depth AND b.prefix = u.prefix
  GROUP BY u.doc_id, u.n_bytes, u.h)
SELECT m.doc_id, m.n_bytes, CASE WHEN m.depth = 0 THEN '' ELSE lpad(bin(b.prefix), m.depth, '0') END AS shard, m.depth,
       b.shard_bytes, b.shard_docs, b.shard_bytes <= {LIMIT_BYTES} AS fits
FROM m JOIN b ON b.depth = m.depth AND b.prefix = m.h >> (60 - m.depth)
"""
