"""Exact nearest neighbours of embeddings by Euclidean distance, counted in documents.

Vectors are put into cells, each around a centre, whose radius is known for every project. A query first
searches the cells that are nearest until they have enough documents; the distance of the last of
these is a bound, and by the triangle inequality a cell further off than the bound and its radius has nothing
better. What is left of the cells is searched then, so two rounds give the exact result at any limit.

Neighbouring cells of a project share a shelf. A query goes once to a shelf with the cells that it asks there, and its
distances to these are one product of matrices, from which those that may be among the nearest are counted exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seekwell.sources.shared import written

FARTHEST = 1.7976931348623157e308
#: Most vectors and queries, on average, that one group compares.
PART, BLOCK = 50_000, 1_000
#: Rows that centres are fitted on, most of these, most rows of the table of cells, and rounds of the fit.
SAMPLE, CELLS, PLACES, ROUNDS = 20_000, 2_048, 1 << 17, 5
#: The cell of vectors that have no distance to any query.
NOWHERE = -1


def score(dist: Column) -> Column:
    return 1 / (1 + dist)


def valid(vector: str, dims: int) -> Column:
    """Exact dimension and finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def _distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; no number counts as farthest."""
    with np.errstate(all="ignore"):
        found = np.sqrt(np.square(vectors - query).sum(axis=1))
    return np.where(np.isfinite(found), found, FARTHEST)


def _matrix(arrays: pd.Series, dims: int) -> np.ndarray:
    """Vectors as rows; one of another length, or without, is nowhere near."""
    rows = [a if a is not None and len(a) == dims else np.full(dims, np.nan) for a in arrays]
    return np.array(rows, np.float64).reshape(-1, dims)


_HIT = "query_id long, project_name string, path string, chunk_index int, distance double"


def _nearest(vectors: pd.DataFrame, queries: pd.DataFrame, limit: int | None) -> pd.DataFrame:
    """The nearest chunk of each document of a group, and of these the nearest of each project."""
    names = [c.split()[0] for c in _HIT.split(", ")]
    if not len(vectors) or not len(queries):
        return pd.DataFrame({c: [] for c in names})
    found = vectors.sort_values(["project_name", "path", "chunk_index"], kind="stable", ignore_index=True)
    dims = len(queries["query"].iloc[0])
    matrix = _matrix(found["embedding"], dims)
    doc = found.groupby(["project_name", "path"], sort=False, dropna=False).ngroup().to_numpy()
    project = pd.factorize(found["project_name"], use_na_sentinel=False)[0]
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    out = []
    for name, query in zip(queries["query_id"].tolist(), queries["query"], strict=True):
        d = _distances(matrix, np.asarray(query, np.float64))
        by_doc = np.lexsort((d, doc))[starts]  # stable: the first chunk of equals; documents stay in order of path
        order = by_doc[np.lexsort((d[by_doc], project[by_doc]))]
        if limit is not None:
            of = project[order]
            first = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1])
            order = order[np.arange(len(order)) - np.repeat(first, np.diff([*first, len(order)])) < limit]
        hits = found.iloc[order]
        out.append(pd.DataFrame({"query_id": name, "project_name": hits["project_name"], "path": hits["path"], "chunk_index": hits["chunk_index"], "distance": d[order]}))
    return pd.concat(out)


#: Products that a task holds at a time, and how far they may be off, as a part of the squared lengths.
PRODUCTS, OFF = 4_000_000, 1e-9


def _nearest_asked(vectors: pd.DataFrame, queries: pd.DataFrame, limit: int | None) -> pd.DataFrame:
    """``_nearest`` of one project's shelf, whose cells ``cells`` of the queries says; all are met where numbers are too large."""
    if limit is None or not len(vectors) or not len(queries):
        return _nearest(vectors, queries, limit)
    found = vectors.sort_values(["path", "chunk_index"], kind="stable", ignore_index=True)
    asked = np.array([np.asarray(q, np.float64) for q in queries["query"]])
    matrix = _matrix(found["embedding"], asked.shape[-1])
    with np.errstate(all="ignore"):
        own, theirs = np.square(matrix).sum(axis=1), np.square(asked).sum(axis=1)
    if not (np.isfinite(own).all() and np.isfinite(theirs).all()):
        return _nearest(vectors, queries, limit)
    doc = pd.factorize(found["path"], use_na_sentinel=False)[0]
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    by_cell = np.argsort(found["cell"].to_numpy(), kind="stable")
    cells, begin = np.unique(found["cell"].to_numpy()[by_cell], return_index=True)
    ends = np.append(begin[1:], len(by_cell))
    back = np.argsort(by_cell)
    apart, own = matrix[by_cell], own[by_cell]
    wants = np.zeros((len(asked), len(cells)), bool)
    for i, c in enumerate(queries["cells"]):
        wants[i, np.isin(cells, np.asarray(c))] = True
    step, out = max(1, PRODUCTS // len(found)), []
    for at in range(0, len(asked), step):
        some, want = asked[at : at + step], wants[at : at + step]
        near = np.full((len(some), len(found)), np.inf)
        for c in np.flatnonzero(want.any(axis=0)).tolist():
            i, a, b = np.flatnonzero(want[:, c]), begin[c], ends[c]
            near[i, a:b] = own[a:b] - 2 * (some[i] @ apart[a:b].T)
        near = near[:, back] + theirs[at : at + step, None]
        bound = np.full(len(some), np.inf)
        if len(starts) > limit:
            bound = np.partition(np.minimum.reduceat(near, starts, axis=1), limit - 1, axis=1)[:, limit - 1]
        slack = OFF * (theirs[at : at + step] + own.max())
        q, row = np.nonzero((near <= (bound + slack)[:, None]) & (near < np.inf))
        d = np.concatenate([np.zeros(0), *(_distances(matrix[row[k : k + 50_000]], some[q[k : k + 50_000]]) for k in range(0, len(q), 50_000))])
        order = np.lexsort((row, d, doc[row], q))
        q, row, d = q[order], row[order], d[order]
        first = np.ones(len(q), bool)
        first[1:] = (q[1:] != q[:-1]) | (doc[row][1:] != doc[row][:-1])
        q, row, d = q[first], row[first], d[first]
        order = np.lexsort((row, d, q))
        q, row, d = q[order], row[order], d[order]
        begins = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        keep = np.arange(len(q)) - np.repeat(begins, np.diff([*begins, len(q)])) < limit
        out.append((q[keep] + at, row[keep], d[keep]))
    q, row, d = (np.concatenate(c) for c in zip(*out, strict=True))
    hits = found.iloc[row]
    names = queries["query_id"].to_numpy()[q]
    return pd.DataFrame({"query_id": names, "project_name": hits["project_name"].to_numpy(), "path": hits["path"].to_numpy(), "chunk_index": hits["chunk_index"].to_numpy(), "distance": d})


def centres(rows: DataFrame, n: int, dims: int) -> np.ndarray:
    """At most ``CELLS`` centres of ``n`` vectors, as many as the root of their number, by k-means on a sample with the smallest hashes."""
    projects = rows.agg(F.approx_count_distinct("project_name")).first()[0]
    most = int(max(1, min(CELLS, np.sqrt(n), PLACES / max(1, projects))))
    by = F.xxhash64("project_name", "path", "chunk_index")
    share = min(1.0, 1.5 * SAMPLE / max(1, n))
    some = rows if share == 1.0 else rows.where(F.pmod(by, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = _matrix(some.orderBy(by, "project_name", "path", "chunk_index").limit(SAMPLE).select("embedding").toPandas()["embedding"], dims)
    sample = sample[np.isfinite(sample).all(axis=1)]
    if not len(sample):
        return np.zeros((1, dims))
    found = sample[:: max(1, len(sample) // most)][:most].copy()
    for _ in range(ROUNDS):
        of = _nearest_centre(sample, found)[0]
        sums, counts = np.zeros_like(found), np.bincount(of, minlength=len(found))
        np.add.at(sums, of, sample)
        found[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return found


def _nearest_centre(matrix: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its distance."""
    of = np.zeros(len(matrix), np.int64)
    for at in range(0, len(matrix), 4096):
        part = matrix[at : at + 4096]
        with np.errstate(all="ignore"):
            of[at : at + 4096] = np.nan_to_num((np.square(found).sum(axis=1) - 2 * part @ found.T), nan=np.inf).argmin(axis=1)
    return of, _distances(matrix, found[of])


_PLACED = "project_name string, path string, chunk_index int, embedding array<double>, cell int, off double"


def placed(rows: DataFrame, found: np.ndarray) -> DataFrame:
    """Rows with their ``cell`` and how far ``off`` its centre they are; those without a distance are nowhere."""
    dims = found.shape[1]

    def place(parts):
        for pdf in parts:
            matrix = _matrix(pdf["embedding"], dims)
            of, off = _nearest_centre(matrix, found)
            good = np.isfinite(matrix).all(axis=1) & (off < FARTHEST)
            yield pdf.assign(cell=np.where(good, of, NOWHERE).astype(np.int32), off=np.where(good, off, 0.0))

    own = rows.select("project_name", "path", F.col("chunk_index").cast("int").alias("chunk_index"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.mapInPandas(place, _PLACED)


class Cells:
    """Cells of each project: their centres and radii, and how many documents and rows they have."""

    def __init__(self, found: np.ndarray, stats: pd.DataFrame) -> None:
        self.found = found
        self.projects = [(name, part["cell"].to_numpy(), part["radius"].to_numpy(), part["docs"].to_numpy()) for name, part in stats.groupby("project_name", sort=True, dropna=False)]

    def nearest(self, query: np.ndarray):
        """For each project its cells, in order of the least distance that a vector in them can have, these distances, and the documents."""
        off = _distances(self.found, query)
        for name, cells, radius, docs in self.projects:
            there = np.where(cells == NOWHERE, FARTHEST, off[cells])
            slack = 1e-9 * (1 + there)  # distances are rounded
            with np.errstate(over="ignore"):
                least = np.where(there < FARTHEST, np.maximum(0, there - radius - slack), np.where(cells == NOWHERE, FARTHEST, 0))
            order = np.lexsort((there, least))
            yield None if name is None or name != name else name, cells[order], least[order], docs[order]


_ASKED = "query_id long, project_name string, cell int"


def _asked(queries: DataFrame, cells: Cells, limit: int, bounds: DataFrame | None = None) -> DataFrame:
    """Cells that queries search: at first those that are nearest and have enough documents; with ``bounds``, all others within these."""

    def first(parts):
        for pdf in parts:
            yield from _rows((q, name, own[: (docs.cumsum() < limit).sum() + 1]) for q in _queries(pdf) for name, own, _, docs in cells.nearest(q[1]))

    def within(pdf):
        for q, known in zip(_queries(pdf), pdf["bounds"], strict=True):
            bound = {} if known is None else {b["project_name"]: b["bound"] for b in known}
            for name, own, least, docs in cells.nearest(q[1]):
                done = (docs.cumsum() < limit).sum() + 1
                yield q, name, own[done:][least[done:] <= bound.get(name, FARTHEST)]

    def rest(parts):
        for pdf in parts:
            yield from _rows(within(pdf))

    if bounds is None:
        return queries.mapInPandas(first, _ASKED)
    return queries.join(bounds.groupBy("query_id").agg(F.collect_list(F.struct("project_name", "bound")).alias("bounds")), "query_id", "left").mapInPandas(rest, _ASKED)


def _queries(pdf: pd.DataFrame):
    return [(int(i), np.asarray(q, np.float64)) for i, q in zip(pdf["query_id"], pdf["query"], strict=True)]


#: Most rows of a frame of queries and their cells.
ASKED_ROWS = 20_000


def _rows(found):
    """Frames of cells that queries ask, of ``ASKED_ROWS`` each at most: together they may be queries times cells."""
    out, size = [], 0

    def frame() -> pd.DataFrame:
        many = [len(c) for *_, c in out]
        columns = (np.repeat(np.array([o[k] for o in out], kind), many) for k, kind in ((0, np.int64), (1, object)))
        cells = np.concatenate([np.zeros(0, np.int32), *(c for *_, c in out)]).astype(np.int32)
        return pd.DataFrame(dict(zip(_ASKED_NAMES, (*columns, cells), strict=True)))

    for q, name, own in found:
        for at in range(0, len(own), ASKED_ROWS):
            rest = own[at : at + ASKED_ROWS]
            if size + len(rest) > ASKED_ROWS:
                yield frame()
                out, size = [], 0
            out.append((q[0], name, rest))
            size += len(rest)
    yield frame()


_ASKED_NAMES = [c.split()[0] for c in _ASKED.split(", ")]


def shelves(stats: DataFrame, limit: int | None) -> DataFrame:
    """The ``shelf`` of each cell, with about ``PART`` rows, and the parts that a larger one is dealt into. Without a limit each cell is one."""
    if limit is None:
        return stats.select("project_name", "cell", F.col("cell").alias("shelf"), F.ceil(F.col("rows") / PART).cast("int").alias("parts"))
    before = F.sum("rows").over(W.partitionBy("project_name").orderBy("cell")) - F.col("rows")
    placed_ = stats.withColumn("shelf", F.when(F.col("cell") == NOWHERE, NOWHERE).otherwise(F.floor(before / PART)).cast("int"))
    whole = F.sum("rows").over(W.partitionBy("project_name", "shelf"))
    return placed_.select("project_name", "cell", "shelf", F.ceil(whole / PART).cast("int").alias("parts"))


def _searched(rows: DataFrame, sizes: DataFrame, asked: DataFrame, limit: int | None, queries: DataFrame) -> DataFrame:
    """The best documents of the cells that queries ask, a project and shelf each. A large shelf is dealt into parts, its queries into blocks."""
    of = lambda some, plan, *keys: some.join(plan, [some[k].eqNullSafe(plan[f"_{k}"]) for k in keys]).drop(*(f"_{k}" for k in keys))
    known = lambda plan, *keys: plan.withColumnsRenamed({k: f"_{k}" for k in keys})
    key = ("project_name", "shelf")
    of_cell = known(sizes.select("project_name", "cell", "shelf"), "project_name", "cell")
    once = written(of(asked, of_cell, "project_name", "cell").groupBy("query_id", *key).agg(F.collect_list("cell").alias("cells")))
    blocks = known(once.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), *key)
    plan = known(of(sizes.select(*key, "parts").distinct(), blocks, *key), *key)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = of(of(rows, of_cell, "project_name", "cell"), plan, *key).select(
        "project_name", "path", "chunk_index", "embedding", "cell", "shelf", F.pmod(F.xxhash64("path"), "parts").cast("int").alias("part"), every("blocks").alias("block")
    )
    right = of(once, plan, *key).join(queries, "query_id").select(
        "query_id", "query", "cells", *key, F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), every("parts").alias("part")
    )

    def compared(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _nearest_asked(a, b, limit)

    by = [*key, "part", "block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(compared, _HIT)


def nearest_documents(vectors: DataFrame, queries: DataFrame, limit: int | None, scope: list[str] | None = None) -> DataFrame:
    """The ``limit`` nearest documents of each project for each query, by their nearest chunk.

    ``vectors(project_name, path, chunk_index, embedding)``; ``queries(query_id, query)``, which may grow
    with the vectors. The scope filter comes before all else. Without a limit every pair is met.
    """
    rows = vectors if scope is None else vectors.where(F.col("project_name").isin(scope))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
    one = asked.select(F.size("query")).first()
    if one is None:
        best = rows.sparkSession.createDataFrame([], _HIT)
    else:
        best = _in_rounds(rows, asked, limit, one[0])[0]
    doc = W.partitionBy("query_id", "project_name").orderBy("distance", "path", "chunk_index")
    # a document may have hits in several cells
    own = best.groupBy("query_id", "project_name", "path").agg(F.min(F.struct("distance", "chunk_index")).alias("h"))
    ranked = own.select("query_id", "project_name", "path", "h.chunk_index", "h.distance").withColumn("rank", F.row_number().over(doc))
    kept = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    return kept.withColumn("score", score(F.col("distance")))


def _in_rounds(rows: DataFrame, queries: DataFrame, limit: int | None, dims: int) -> tuple[DataFrame, float]:
    """Hits of both rounds, and the share of pairs of queries and vectors that were met."""
    n = rows.count()
    most = limit if limit is not None else (1 << 62)
    found = centres(rows, n, dims)
    cells = written(placed(rows, found))
    stats = written(
        cells.groupBy("project_name", "cell").agg(F.max("off").alias("radius"), F.approx_count_distinct("path").alias("docs"), F.count("*").alias("rows"))
    )
    known = Cells(found, stats.toPandas())
    sizes = written(shelves(stats, limit))
    first = written(_asked(queries, known, most))
    best = written(_searched(cells, sizes, first, limit, queries))
    if limit is None:
        return best, 1.0
    place = W.partitionBy("query_id", "project_name").orderBy("d", "path")
    docs = best.groupBy("query_id", "project_name", "path").agg(F.min("distance").alias("d")).withColumn("k", F.row_number().over(place))
    second = written(_asked(queries, known, most, docs.where(F.col("k") == limit).select("query_id", "project_name", F.col("d").alias("bound"))))
    met = first.unionByName(second).groupBy("project_name", "cell").count().join(stats, ["project_name", "cell"]).agg(F.sum(F.col("count") * F.col("rows"))).first()[0] or 0
    return best.unionByName(_searched(cells, sizes, second, limit, queries)), met / max(1, n * queries.count())


def merged(hits: DataFrame, limit: int | None) -> DataFrame:
    """The best of all projects for each query: score, then project and path."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "project_name", "path")
    ranked = hits.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)
