"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact cosines.

A rotation is learnt on a bounded sample so that the signs of a rotated vector are a balanced code
that loses little. Vectors aren't centred: near their mean angles are larger, and the bound on
bits that differ would be lost. Some rotations from different starts give more bits than a
vector has components. The code is cut into substrings; each is a table, and vectors that have
equal substrings there share a bucket. What decides is the cosine of the original vectors.

Vectors within the least cosine differ in 6.4 % of the bits of a random code and fewer of a learnt
one. Substrings are as long as the number of vectors asks for, and there are as many tables as miss
a pair at the least cosine with a probability of ``MISS`` only.

Equal vectors are one class, which is compared once. A bucket never gives its pairs: each
vector gets the number of its partners in the bucket and a link to its group there, and a pair
counts in the first table that has it. A bucket of more than ``HOT`` vectors is dealt into parts, and each
two parts meet in a task of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekwell.llm.common import read, written
from seekwell.llm.components import connected_components

LEAST = 0.98
#: Vectors that rotations are learnt on: those with the smallest hashes.
SAMPLE = 10_000
ROUNDS = 30
#: Share of pairs at the least cosine that the tables may miss, for bits of a random code.
MISS = 0.01
#: Vectors of a bucket that one task compares, about; vectors held at a time; rows of one product.
HOT, _HELD, _ROWS = 4_000, 20_000, 1_000
#: Buckets up to this size are compared by lag.
_SMALL = 16
#: What names a bucket, or two parts of one: a hash of label, table and code, another one of label and components, the parts.
BUCKET = ["key", "kind", "a", "b"]


def plan(n: int, least: float = LEAST) -> tuple[int, int]:
    """(bits of a substring, number of tables) for ``n`` vectors: buckets hold a few vectors at every size."""
    width = min(32, max(8, math.ceil(math.log2(max(2, n))) - 4))
    hit = (1 - math.acos(least) / math.pi) ** width
    return width, max(1, math.ceil(math.log(MISS) / math.log(1 - hit)))


def learnt_rotation(units: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """The orthogonal matrix that brings vectors closest to the signs of what it makes of them.

    Signs and rotation are improved by turns: for given signs the best rotation is that of the
    orthogonal Procrustes problem.
    """
    dims = units.shape[1]
    turned = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))[0]
    for _ in range(rounds if len(units) else 0):
        signs = np.where(units @ turned >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(units.T @ signs)
        turned = u @ vt
    return turned


class Quantiser:
    """Rotations by number of components; lengths that the sample lacks get rotations unlearnt."""

    def __init__(self, sample: list[np.ndarray], width: int, tables: int) -> None:
        self.width, self.tables = width, tables
        by_length: dict[int, list] = {}
        for v in sample:
            by_length.setdefault(len(v), []).append(v)
        self.known = {n: self._fitted(np.array(vs), n) for n, vs in by_length.items()}

    def _fitted(self, units: np.ndarray, dims: int) -> np.ndarray:
        many = -(-self.width * self.tables // dims)
        return np.concatenate([learnt_rotation(units, seed) for seed in range(many)], axis=1)

    def codes(self, units: np.ndarray) -> np.ndarray:
        """Substrings of the codes of unit vectors of one length, a column for each table."""
        dims = units.shape[1]
        turned = self.known[dims] if dims in self.known else self._fitted(np.zeros((0, dims)), dims)
        bits = (units @ turned >= 0)[:, : self.width * self.tables]
        return bits.reshape(len(units), self.tables, self.width).astype(np.uint64) @ (np.uint64(1) << np.arange(self.width, dtype=np.uint64))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision; huge and tiny ones neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.square(scaled).sum(axis=1, keepdims=True))


def _by_length(arrays: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each number of components, and their unit vectors."""
    lengths = arrays.map(len).to_numpy()
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, unit(np.stack(arrays.iloc[rows].to_list()).astype(np.float64))


def is_comparable() -> Column:
    """Whether the label isn't null and the vector has finite components only, not all of them zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def fit(classes: DataFrame, n: int, least: float) -> Quantiser:
    """Learn from the ``SAMPLE`` vectors of ``classes(embedding, h, ...)`` with the smallest hashes."""
    share = min(1.0, 1.2 * SAMPLE / max(1, n))  # a little more than is taken, so that only this much is put in order
    near = classes.where(F.shiftrightunsigned("h", 1) / F.lit(2.0**63) <= share) if share < 1 else classes
    rows = near.orderBy("h", "id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    units = [v for _, some in _by_length(rows) for v in some] if len(rows) else []
    return Quantiser(units, *plan(n, least))


def _coded(classes: DataFrame, quantiser: Quantiser) -> DataFrame:
    """Adds ``keys``: the bucket of a class in each table, which also tells the label and the number of components."""

    @F.pandas_udf("array<long>")
    def codes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for arrays in parts:
            out = np.empty((len(arrays), quantiser.tables), np.int64)
            for rows, units in _by_length(arrays):
                out[rows] = quantiser.codes(units)
            yield pd.Series(list(out))

    hashed = F.transform("codes", lambda code, table: F.xxhash64("label", F.size("embedding"), table, code))
    return classes.withColumn("codes", codes("embedding")).select(
        "id", "many", "embedding", hashed.alias("keys"), F.xxhash64(F.lit(11), "label", F.size("embedding")).alias("kind")
    )


def _met(coded: DataFrame) -> DataFrame:
    """Rows ``(key, kind, a, b, part, id, many, embedding, keys, table)``: a bucket, or two parts of a large one.

    The sizes of buckets are counted on keys alone; only those of several classes go on.
    """
    sizes = coded.select(F.explode("keys").alias("key")).groupBy("key").count()
    shared = sizes.where("count > 1").select("key", F.ceil(F.col("count") / HOT).cast("int").alias("parts"))
    rows = coded.select("id", "many", "embedding", "keys", "kind", F.posexplode("keys").alias("table", "key")).join(shared, "key")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id", "key"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_other")
    pairs = dealt.select("*", other)
    return pairs.select(
        *BUCKET[:2], F.least("part", "_other").alias("a"), F.greatest("part", "_other").alias("b"), "part", "id", "many", "embedding", "keys", "table"
    )


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least connected number for each of ``n``, by links (u, v)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, u, least)
        np.minimum.at(root, v, least)
        root = np.minimum(root, root[root])
        if (root == before).all():
            return root


class _Group:
    """Rows of one or several whole buckets (or pairs of parts), compared together."""

    def __init__(self, pdf: pd.DataFrame, least: float) -> None:
        self.least, self.n = least, len(pdf)
        self.ids, self.many = pdf["id"].to_numpy(np.int64), pdf["many"].to_numpy(np.int64)
        self.keys, self.table = np.stack(pdf["keys"].to_list()), pdf["table"].to_numpy(np.int64)
        self.part = pdf["part"].to_numpy(np.int64)
        bucket = pdf[BUCKET].to_numpy(np.int64)
        self.starts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]).any(axis=1)]))
        self.sizes = np.diff(np.concatenate([self.starts, [self.n]]))
        self.crossed = (bucket[:, 2] != bucket[:, 3])[self.starts]
        self.arrays, self.partners = pdf["embedding"], np.zeros(self.n, np.int64)
        self.linked: list[np.ndarray] = []

    def _take(self, i: np.ndarray, j: np.ndarray) -> None:
        """Count pairs that are near enough, each in the first table that has it."""
        first = (self.keys[i] == self.keys[j]).argmax(axis=1) == self.table[i]
        i, j = i[first], j[first]
        np.add.at(self.partners, i, self.many[j])
        np.add.at(self.partners, j, self.many[i])
        # in the links only a spanning forest stays
        self.linked.append(np.stack([i, j]))
        if sum(x.shape[1] for x in self.linked) > 50 * self.n:
            self._shrink()

    def _shrink(self) -> np.ndarray:
        u, v = np.concatenate(self.linked, axis=1) if self.linked else np.zeros((2, 0), np.int64)
        root = _roots(self.n, u, v)
        own = np.flatnonzero(root != np.arange(self.n))
        self.linked = [np.stack([own, root[own]])]
        return root

    def compare(self) -> pd.DataFrame:
        units = np.empty(self.n, object)
        for rows, some in _by_length(self.arrays):
            for k, v in zip(rows.tolist(), some, strict=True):
                units[k] = v
        of = np.repeat(np.arange(len(self.starts)), self.sizes)
        small = self.sizes <= _SMALL
        ordered = np.flatnonzero(small[of])
        if len(ordered):
            # lengths differ between buckets, never in one
            for dims in np.unique(lengths := np.array([len(units[k]) for k in ordered])):
                self._by_lag(ordered[lengths == dims], np.stack(units[ordered[lengths == dims]]), of)
        for g in np.flatnonzero(~small):
            self._by_product(self.starts[g], self.sizes[g], np.stack(units[self.starts[g] : self.starts[g] + self.sizes[g]]), self.crossed[g])
        root = self._shrink()
        hit = np.flatnonzero(self.partners > 0)
        return pd.DataFrame({"id": self.ids[hit], "partners": self.partners[hit], "root": self.ids[root[hit]]})

    def _by_lag(self, rows: np.ndarray, units: np.ndarray, of: np.ndarray) -> None:
        for lag in range(1, min(_SMALL, len(rows))):
            at = np.flatnonzero(of[rows[lag:]] == of[rows[:-lag]])
            if not len(at):
                break
            near = at[np.einsum("ij,ij->i", units[at], units[at + lag]) >= self.least]
            i, j = rows[near], rows[near + lag]
            apart = (self.part[i] != self.part[j]) | ~self.crossed[of[i]]
            self._take(i[apart], j[apart])

    def _by_product(self, start: int, size: int, units: np.ndarray, crossed: bool) -> None:
        for at in range(0, size, _ROWS):
            i, j = np.nonzero(units[at : at + _ROWS] @ units[at:].T >= self.least)
            ahead = j > i
            i, j = i[ahead] + at + start, j[ahead] + at + start
            if crossed:
                apart = self.part[i] != self.part[j]
                i, j = i[apart], j[apart]
            for k in range(0, len(i), 1 << 20):
                self._take(i[k : k + (1 << 20)], j[k : k + (1 << 20)])


def _compared(least: float):
    def compared(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by bucket; a bucket that a batch cuts is carried over whole."""
        held: list[pd.DataFrame] = []
        n = 0
        for pdf in parts:
            held.append(pdf)
            n += len(pdf)
            if n < _HELD:
                continue
            rows = pd.concat(held, ignore_index=True)
            bucket = rows[BUCKET].to_numpy(np.int64)
            cut = int(np.flatnonzero((bucket != bucket[-1]).any(axis=1))[-1]) + 1 if (bucket[0] != bucket[-1]).any() else 0
            if cut:
                yield _Group(rows.iloc[:cut], least).compare()
            held, n = [rows.iloc[cut:].reset_index(drop=True)], len(rows) - cut
        if n:
            yield _Group(pd.concat(held, ignore_index=True), least).compare()

    return compared


def class_links(classes: DataFrame, n: int, least: float = LEAST) -> DataFrame:
    """Rows ``(id, partners, root)`` of ``classes(id, label, embedding, many, h)``, several for a class.

    ``partners`` add up to the vectors in other classes that the class is linked with; ``root`` is connected
    with it by links.
    """
    coded = written(_coded(classes, fit(classes, n, least)))
    met = _met(coded).repartition(*BUCKET).sortWithinPartitions(*BUCKET)
    return met.mapInPandas(_compared(least), "id long, partners long, root long")


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """Links and groups of ``vectors(vec_id, embedding, label, ...)``, a row each.

    ``n_links``: other vectors of the same label with a cosine of ``least`` or more. ``component_id``: the smallest
    vec_id that links lead to, its own included. ``kept``: whether that is its own. A vector that is null, empty,
    zero or not all finite, or without a label, links with nothing; nor do vectors of different numbers of
    components. A null vec_id names a component only, as null, if no other id is in it. Repeated
    rows are vectors of their own. Other columns are ignored; an empty table gives an empty table.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    # minus zero is zero, as vectors that only differ there are equal
    same = F.struct("label", F.transform("embedding", lambda x: x + F.lit(0.0)).alias("embedding"))
    good = own.where(is_comparable()).select("vec_id", same.alias("v"))
    classes = good.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("many"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "v.*", "first", "many", F.xxhash64("v").alias("h")))
    links = written(class_links(classes, classes.count(), least))
    parts = connected_components(links.select(F.col("id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "id")
    partners = links.groupBy("id").agg(F.sum("partners").alias("partners"))
    found = classes.select("id", "first", "many").join(partners, "id", "left").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = found.groupBy("component").agg(F.min("first").alias("component_id"))
    found = written(found.join(names, "component").select("id", "component_id", (F.col("many") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links")))
    told = classes.select("id", F.struct("label", "embedding").alias("v")).join(found, "id").drop("id")
    rows = good.join(told, "v").select("vec_id", "n_links", "component_id")
    alone = own.where(~is_comparable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_itq_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
