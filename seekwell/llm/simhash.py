"""Near-duplicate texts by 64-bit SimHash, searched with Golay-code keys.

A fingerprint is cut into three segments. The perfect binary Golay code of length 23
corrects three errors, so every segment (padded with zeros) decodes to one codeword, and
the decodings of the segment and its 23 neighbours give one or six codewords. Two segments
within two differing bits of each other share a codeword: some word lies within one bit of
both. If two fingerprints differ in at most four bits, some two of their three segments
differ in at most two bits together (the pairs' sums add up to eight over three pairs), so
the pair of codewords of those two segments is a key that both have. Fingerprints that meet
under a key are then verified on all 64 bits.

Inside a key's group only links that join parts not joined yet are kept. That is a
spanning forest of the group's links: it loses no connection, and its size is linear in
the group's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.llm.common import doc_key, read, written
from seekwell.llm.components import connected_components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR = 0b110001110101
_WIDTHS = (22, 21, 21)
#: Groups up to this size compare by lag; larger ones grow their parts one text at a time.
_SMALL = 24

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text: bit i is 1 if it is set in over half of the shingle hashes."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return 0
    hashed, last = xxhash.xxh64_intdigest, len(words) - shingle
    if last < 1:
        return hashed(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:last]]).tolist()
    h = np.fromiter(
        (hashed(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)),
        np.uint64,
        last + 1,
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64)[ones * 2 > len(h)]).sum())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, k1, k2, fp)``: a row's key and fingerprint."""

    @F.pandas_udf("long")
    def simhash(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", doc_key().alias("k"), simhash(F.col("text")).alias("fp")).select("doc_id", "k.*", "fp")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (_GENERATOR << (bit - 11))
    return rest


def decoding_table() -> np.ndarray:
    """For each of 2048 syndromes, the one or six error patterns that lead to nearby codewords.

    Entry 0 is the word's own decoding; -1 fills rows of one.
    """
    bits = 1 << np.arange(23, dtype=np.int64)
    patterns = [np.zeros(1, np.int64), bits]
    patterns.append(np.array([a | b for i, a in enumerate(bits) for b in bits[:i]]))
    patterns.append(np.array([a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]))
    leaders = np.concatenate(patterns)
    leader = np.empty(2048, np.int64)
    leader[_syndrome(leaders)] = leaders
    flips = _syndrome(bits)
    table = np.full((2048, 6), -1, np.int64)
    for s in range(2048):
        near = {int(leader[s ^ f] ^ b) for f, b in zip(flips, bits, strict=True)} - {int(leader[s])}
        table[s, : 1 + len(near)] = [int(leader[s]), *sorted(near)]
    return table


def codewords(segments: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Numbers of the codewords near segments of up to 23 bits: one or six each, -1 fills up."""
    errors = table[_syndrome(segments)]
    return np.where(errors < 0, -1, (segments[:, None] ^ errors) >> 11)


def golay_keys(fps: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64): positions into ``fps``, and a key each."""
    found, at = [], 0
    for width in _WIDTHS:
        found.append(codewords(((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64), table))
        at += width
    rows, keys = [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        both = (found[i][:, :, None] << 12) | found[j][:, None, :]
        ok = (found[i][:, :, None] >= 0) & (found[j][:, None, :] >= 0)
        rows.append(np.nonzero(ok)[0])
        keys.append(both[ok] | (pair << 24))
    return np.concatenate(rows), np.concatenate(keys)


def _grown(values: np.ndarray, most: int) -> tuple[list, list]:
    """Spanning links of one large group: each text met takes in all texts near it."""
    us, vs, rest = [], [], values
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            one = front.pop()
            near = np.bitwise_count(rest ^ one) <= most
            if near.any():
                got = rest[near]
                us.append(np.full(len(got), one, np.uint64))
                vs.append(got)
                front.extend(got.tolist())
                front = [np.uint64(x) for x in front]
                rest = rest[~near]
    return us, vs


def linked(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints that share a key; ``keys`` need not be sorted."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, int)
    sizes = np.diff(cuts)
    us, vs = [], []
    small = np.repeat(sizes <= _SMALL, sizes)
    k, f = keys[small], fps[small]
    for lag in range(1, min(_SMALL, len(k))):
        same = k[lag:] == k[:-lag]
        if not same.any():
            break
        a, b = f[:-lag][same], f[lag:][same]
        near = np.bitwise_count(a ^ b) <= most
        us.append(a[near])
        vs.append(b[near])
    for g in np.flatnonzero(sizes > _SMALL):
        u, v = _grown(fps[cuts[g] : cuts[g + 1]], most)
        us += u
        vs += v
    if not us:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(us), np.concatenate(vs)


def near_links(distinct: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """``distinct(fp)`` of distinct fingerprints to spanning links ``(u, v)`` of those within
    ``most`` (at most 4) differing bits."""
    if not 0 <= most <= MAX_BITS:
        raise ValueError("the keys guarantee links of 0 to 4 differing bits")
    table = decoding_table()

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            fps = pdf["fp"].to_numpy(np.int64)
            rows, keys = golay_keys(fps.view(np.uint64), table)
            for at in range(0, len(rows), 200_000):
                yield pd.DataFrame({"key": keys[at : at + 200_000].astype(np.int32), "fp": fps[rows[at : at + 200_000]]})

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key; a group that a batch cuts is carried over whole."""
        keys, fps = np.zeros(0, np.int32), np.zeros(0, np.int64)

        def out(k: np.ndarray, f: np.ndarray) -> pd.DataFrame:
            u, v = linked(k, f.view(np.uint64), most)
            return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)}).drop_duplicates()

        for pdf in parts:
            keys = np.concatenate([keys, pdf["key"].to_numpy(np.int32)])
            fps = np.concatenate([fps, pdf["fp"].to_numpy(np.int64)])
            if len(keys) > 200_000 and keys[0] != keys[-1]:
                cut = int(np.searchsorted(keys, keys[-1]))
                yield out(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield out(keys, fps)

    keyed = distinct.select("fp").mapInPandas(emit, "key int, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInPandas(verify, "u long, v long")


def _grouped(docs: DataFrame, shingle: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, k1, k2, fp)``, and each fingerprint's component ``(fp, component)``."""
    marked = written(fingerprints(docs, shingle))
    nodes = marked.select("fp").distinct()
    parts = connected_components(near_links(nodes, most)).withColumnRenamed("node", "fp")
    return marked, nodes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """Fingerprint and component of every document.

    ``docs(doc_id, text, ...)`` gives ``(doc_id, fingerprint, component_id)``, a row for each
    input row. A null or wordless text has fingerprint zero and links like any other. A
    component is named by the smallest doc_id in it; null ids take part in links but name
    a component only (as null) if it has no other id. Repeated rows and ids are kept as they
    come. Other columns are ignored. An empty table gives an empty table.
    """
    marked, parts = _grouped(docs, shingle, most)
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first")).join(parts, "fp")
    names = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = written(nodes.join(names, "component").select("fp", "component_id"))
    return marked.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def first_of_each_group(docs: DataFrame, shingle: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """Keep one row of each component, that with the smallest doc_id; columns stay as they are.

    Null ids come last, and rows with equal ids go by a hash of the text. Of rows that
    repeat id and text one stays.
    """
    return first_of_components(docs, *_grouped(docs, shingle, most))


def first_of_components(docs: DataFrame, marked: DataFrame, parts: DataFrame) -> DataFrame:
    """The first row of each component, by rows ``(doc_id, k1, k2, fp)`` and parts ``(fp, component)``."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k1", "k2")
    least = marked.groupBy("fp").agg(F.min(order).alias("first")).join(parts, "fp")
    keep = written(least.groupBy("component").agg(F.min("first").alias("first")).select("first.k1", "first.k2"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_key().alias("k"))
    kept = rows.select("row", "k.*").join(keep, ["k1", "k2"], "left_semi")
    # of rows that repeat id and text the same one stays in every run: the least by all its columns
    return kept.groupBy("k1", "k2").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")


def op2_simhash_golay(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
