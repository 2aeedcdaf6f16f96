"""What the operators share: the shared folder, intermediate tables, and the row key.

Rows of a text table are told apart by ``(doc_id, text)`` only. Rows that repeat both
get the same result each, so joining a per-key result back to the input is a left join
on ``doc_key`` whose right side has one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekwell.sources.shared import written

__all__ = ["WORD", "crc32_sql", "doc_key", "input_mb", "read", "task_count", "written"]

#: Words are runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits that name a row by its id and text; null and empty differ from all else."""
    parts = (F.col(doc_id), F.coalesce(F.col(text), F.lit("")))
    return F.struct(F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(7), *parts).alias("k2"))


def input_mb(docs: DataFrame) -> float:
    """MB of the texts of ``docs(text, ...)``, counted; files may be a small part of what they hold."""
    return (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 1e6


def task_count(docs: DataFrame, mb_per_task: float, least: int = 1) -> int:
    """So many tasks that each gets about ``mb_per_task`` of the input, whatever its size."""
    return max(least, int(input_mb(docs) / mb_per_task) + 1)


_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({0}) + 1), lambda k: ascii(substr({0}, k, 1))::BIGINT)),
 lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def crc32_sql(text: str) -> str:
    """DuckDB: the CRC-32 of an expression of ASCII text."""
    return _CRC.format(text)
