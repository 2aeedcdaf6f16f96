"""URL filters: rules by host and path, and a cascade of Bloom filters for exact membership.

The cascade's first filter holds the listed keys. Of all other keys of the corpus, those
that pass it by chance go into a second filter; listed keys that pass the second by
chance go into a third, and so on until no false positive is left. A key of the corpus is
listed if the first filter that it fails is at an odd place. As the filters are built over the
complete universe of keys, that is exact, and no page is joined with the list.

Keys are split over shards by hash, so that each cascade is built by one task from a
bounded number of keys.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from seekwell.llm.common import read, written

#: (verdict, host, path); a rule holds for the host and its subdomains.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
KEYS_PER_SHARD = 500_000
#: Cascades of up to this many bytes in all are broadcast; larger ones are dealt with the pages.
BROADCAST_BYTES = 32 << 20
SALTS = 32
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _AZ, _AZ.lower())
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does.

    Of rules of one length the first given wins.
    """
    rule = verdict = F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bits_of(keys: np.ndarray, level: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
    a, b = _mixed(keys[:, 0], level), _mixed(keys[:, 1], level) | np.uint64(1)
    for i in range(hashes):
        yield (a + np.uint64(i) * b) % np.uint64(bits)


def build_cascade(keys: np.ndarray, listed: np.ndarray) -> bytes:
    """Filters over ``keys`` (distinct rows of two uint64) that tell the ``listed`` from the rest."""
    inside, outside = keys[listed], keys[~listed]
    levels = []
    while len(inside):
        rate = 0.5 if levels else min(0.5, max(1e-4, len(inside) / (2 * max(1, len(outside)))))
        hashes = max(1, round(-math.log2(rate)))
        bits = max(64, math.ceil(len(inside) * -math.log2(rate) / math.log(2)))
        level, flags = len(levels), np.zeros(bits, bool)
        for at in _bits_of(inside, level, bits, hashes):
            flags[at] = True
        levels.append(struct.pack("<QI", bits, hashes) + np.packbits(flags).tobytes())
        passed = np.ones(len(outside), bool)
        for at in _bits_of(outside, level, bits, hashes):
            passed &= flags[at]
        inside, outside = outside[passed], inside
        if len(levels) > 500:
            raise RuntimeError("two keys of the universe have the same 128 bits")
    return struct.pack("<I", len(levels)) + b"".join(levels)


class Cascade:
    def __init__(self, data: bytes) -> None:
        (n,), at, self.levels = struct.unpack_from("<I", data), 4, []
        for _ in range(n):
            bits, hashes = struct.unpack_from("<QI", data, at)
            size = (bits + 7) // 8
            self.levels.append((bits, hashes, np.frombuffer(data, np.uint8, size, at + 12)))
            at += 12 + size

    def listed(self, keys: np.ndarray) -> np.ndarray:
        failed = np.full(len(keys), len(self.levels))
        alive = np.arange(len(keys))
        for level, (bits, hashes, packed) in enumerate(self.levels):
            passed = np.ones(len(alive), bool)
            for at in _bits_of(keys[alive], level, bits, hashes):
                passed &= (packed[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            failed[alive[~passed]] = level
            alive = alive[passed]
        return failed % 2 == 1


def _pairs(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack([pdf["k1"].to_numpy(np.int64), pdf["k2"].to_numpy(np.int64)], axis=1).view(np.uint64)


def _with_hashes(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("k1", F.xxhash64(key)).withColumn("k2", F.xxhash64(F.lit(1), F.col(key)))


def cascades(universe: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> tuple[DataFrame, int]:
    """``universe(key, listed)``, keys repeated as they come, to ``(shard, cascade)`` and the number of shards.

    A key is listed if any of its rows says so; null keys are left out.
    """
    distinct = written(
        _with_hashes(universe.where("key IS NOT NULL"), "key").groupBy("k1", "k2").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    )
    shards = distinct.count() // keys_per_shard + 1

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "cascade": [build_cascade(_pairs(pdf), pdf["listed"].to_numpy(bool))]})

    dealt = distinct.withColumn("shard", F.pmod("k1", F.lit(shards)))
    return written(dealt.groupBy("shard").applyInPandas(build, "shard long, cascade binary")), shards


def with_membership(
    df: DataFrame, key: str, filters: DataFrame, shards: int, broadcast_bytes: int = BROADCAST_BYTES, name: str = "listed"
) -> DataFrame:
    """Adds whether ``key``, a key of the universe, is listed; null is not.

    Small cascades go to every worker. Beyond ``broadcast_bytes`` rows are dealt by shard, each
    shard over ``SALTS`` tasks; a task has one cascade at a time, which comes before its rows, and
    these stream past it, so neither a hot key nor a large shard is gathered. All columns stay
    as they are, but for one that is called ``name``, which is replaced.
    """
    df = df.drop(name)
    k1, k2 = F.xxhash64(key), F.xxhash64(F.lit(1), F.col(key))
    total = filters.agg(F.sum(F.length("cascade"))).first()[0] or 0
    if total <= broadcast_bytes:
        sent = df.sparkSession.sparkContext.broadcast({r.shard: bytes(r.cascade) for r in filters.collect()})

        @F.pandas_udf("boolean")
        def member(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            known = {s: Cascade(c) for s, c in sent.value.items()}
            for a, b in parts:
                keys = np.stack([a.to_numpy(np.int64), b.to_numpy(np.int64)], axis=1).view(np.uint64)
                shard, out = np.mod(a.to_numpy(np.int64), shards), np.zeros(len(a), bool)
                for s in np.unique(shard):
                    if int(s) in known:
                        out[shard == s] = known[int(s)].listed(keys[shard == s])
                yield pd.Series(out)

        return df.withColumn(name, member(k1, k2) & F.col(key).isNotNull())

    own = [f"_{c}{i}" for i, c in enumerate(("k1", "k2", "shard", "salt", "there", "cascade"))]
    while set(own) & set(df.columns):
        own = ["_" + c for c in own]
    first, second, shard, salt, there, cascade = own
    rows = df.select(
        "*", k1.alias(first), k2.alias(second), F.pmod(k1, F.lit(shards)).alias(shard), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias(salt),
        F.col(key).isNotNull().alias(there), F.lit(None).cast("binary").alias(cascade),
    )
    nothing = F.lit(None).cast("long")
    copies = filters.select(
        *(F.lit(None).cast(kind).alias(c) for c, kind in df.dtypes), nothing.alias(first), nothing.alias(second), F.col("shard").alias(shard),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias(salt), F.lit(False).alias(there), F.col("cascade").alias(cascade),
    )
    keep = df.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard and salt, their cascade first."""
        now, now_for = Cascade(struct.pack("<I", 0)), None
        for batch in batches:
            sent = batch.column(batch.schema.get_field_index(cascade))
            of = batch.column(batch.schema.get_field_index(shard)).to_numpy()
            hashes = [batch.column(batch.schema.get_field_index(c)).fill_null(0).to_numpy() for c in (first, second)]
            keys, out = np.stack(hashes, axis=1).view(np.uint64), np.zeros(len(of), bool)
            news = np.flatnonzero(sent.is_valid().to_numpy(zero_copy_only=False)).tolist()
            for a, b in zip([0, *news], [*news, len(of)], strict=True):
                if a in news:
                    now, now_for = Cascade(sent[a].as_py()), of[a]
                mine = np.arange(a, b)[of[a:b] == now_for]
                out[mine] = now.listed(keys[mine])
            out &= batch.column(batch.schema.get_field_index(there)).to_numpy(zero_copy_only=False)
            found = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out)], names=[*keep, name])
            yield found.filter(sent.is_null())

    dealt = copies.unionByName(rows).repartition(shard, salt).sortWithinPartitions(shard, salt, F.col(cascade).isNull())
    return dealt.mapInArrow(judge, StructType([*df.schema.fields, StructField(name, BooleanType())]))


def judged(pages: DataFrame, listed: DataFrame, rules=RULES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages(page_id, url, ...)`` to ``(page_id, host, path, rule, verdict)``, a row each.

    A rule's verdict goes first. Else the page is blocked if its address, host and path
    together, is among ``listed(key)``, and allowed if not. A null url has an empty address.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_key", F.concat("host", "path"))
    universe = rows.select(F.col("_key").alias("key"), F.lit(False).alias("listed")).unionByName(
        listed.select("key", F.lit(True).alias("listed"))
    )
    filters, shards = cascades(universe)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return with_membership(rows, "_key", filters, shards, broadcast_bytes, "_listed").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"),
    )


def tracked_addresses(pages: DataFrame) -> DataFrame:
    """Addresses that some page of the corpus reaches with a ``utm_source`` parameter."""
    host, path = host_and_path(F.col("url"))
    return pages.where(F.col("url").contains("utm_source=")).select(F.concat(host, path).alias("key"))


def op3_bloom_cascade(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, tracked_addresses(pages))


OP3_SQL = """
WITH r AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
s AS (SELECT DISTINCT host || path AS address FROM p WHERE contains(url, 'utm_source=')),
rules(said, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                               ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
b AS (
  SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(said, length(rh || rp)) AS said
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, b.rule,
       coalesce(b.said, CASE WHEN s.address IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN b ON b.page_id = p.page_id AND b.host = p.host AND b.path = p.path LEFT JOIN s ON s.address = p.host || p.path
"""
