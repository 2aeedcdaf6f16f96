"""Exact nearest documents from cells, against a plain comparison of all pairs."""

import numpy as np
import pytest

from seekwell.operators import vector

SCHEMA = "project_name string, path string, chunk_index int, embedding array<double>"


def plain(rows, queries, limit):
    out = []
    for q, v in queries:
        best = {}
        for project, path, chunk, e in rows:
            ok = e is not None and len(e) == len(v) and np.isfinite(e).all()
            d = float(np.sqrt(np.square(np.array(e) - np.array(v)).sum())) if ok else vector.FARTHEST
            key = (project, path)
            best[key] = min(best.get(key, (np.inf, 0)), (d, chunk))
        for project in {p for p, _ in best}:
            own = sorted((d, path, c) for (p, path), (d, c) in best.items() if p == project)
            out += [(q, project, path, c, k + 1, round(d, 9)) for k, (d, path, c) in enumerate(own[:limit])]
    return sorted(out, key=str)


def found(hits):
    return sorted(((h.query_id, h.project_name, h.path, h.chunk_index, h.rank, round(h.distance, 9)) for h in hits.collect()), key=str)


def clustered(n, dims, seed):
    r = np.random.default_rng(seed)
    means = 10 * r.standard_normal((12, dims))
    return [[float(x) for x in means[i % 12] + 0.3 * r.standard_normal(dims)] for i in range(n)]


@pytest.mark.parametrize("part", [vector.PART, 7])
def test_nearest_documents_are_exact(spark, monkeypatch, part):
    monkeypatch.setattr(vector, "PART", part)
    monkeypatch.setattr(vector, "BLOCK", 5)
    vectors = clustered(400, 6, 3)
    rows = [("pq"[i % 7 == 0], f"d{i // 3}", i % 3, v) for i, v in enumerate(vectors)]
    rows += [("p", "none", 0, None), ("p", "short", 0, [1.0]), ("q", "nan", 0, [float("nan")] * 6), ("few", "a", 0, vectors[0]), ("few", "b", 0, None)]
    rows += [("p", "copy", 0, vectors[5]), ("p", "copy2", 0, vectors[5])]
    queries = [(i, vectors[7 * i]) for i in range(12)] + [(99, [100.0] * 6)]
    table, asked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(queries, "query_id long, query array<double>")
    for limit in (1, 4, 200):
        assert found(vector.nearest_documents(table, asked, limit)) == plain(rows, queries, limit)
    scoped = [r for r in rows if r[0] in ("q", "few")]
    assert found(vector.nearest_documents(table, asked, 3, ["q", "few"])) == plain(scoped, queries, 3)
    assert found(vector.nearest_documents(table, asked.limit(2), None)) == plain(rows, queries[:2], 10**9)
    assert vector.nearest_documents(table, asked.limit(0), 3).count() == 0 and vector.nearest_documents(table.limit(0), asked, 3).count() == 0


def test_cells_that_are_far_off_are_not_searched(spark):
    vectors = clustered(3000, 8, 5)
    table = spark.createDataFrame([("p", f"d{i}", 0, v) for i, v in enumerate(vectors)], SCHEMA)
    asked = spark.createDataFrame([(i, vectors[37 * i]) for i in range(30)], "query_id long, query array<double>")
    assert vector._in_rounds(table, asked, 5, 8)[1] < 0.15
