"""Cells that share a shelf are searched together, with the same nearest documents."""

import numpy as np
import pandas as pd
import pytest

from seekwell.operators import vector

SCHEMA = "project_name string, path string, chunk_index int, embedding array<double>"


def test_a_query_has_hits_of_a_shelf_not_of_each_cell(spark):
    """Random vectors: no cell is ruled out."""
    r = np.random.default_rng(4)
    vectors = r.standard_normal((3000, 32)).tolist()
    table = spark.createDataFrame([("p", f"d{i}", 0, v) for i, v in enumerate(vectors)], SCHEMA)
    asked = spark.createDataFrame([(i, vectors[37 * i]) for i in range(30)], "query_id long, query array<double>")
    best, met = vector._in_rounds(table, asked, 5, 32)
    assert met > 0.9 and best.count() <= 30 * 5 * 2


@pytest.mark.parametrize("products", [vector.PRODUCTS, 700])
def test_products_lose_no_hit(monkeypatch, products):
    monkeypatch.setattr(vector, "PRODUCTS", products)
    r = np.random.default_rng(7)
    base = r.standard_normal((40, 5)) * 1e4
    rows = [(f"d{r.integers(60)}", i, base[r.integers(40)] + r.choice([0, 0, 1e-9, 1e-3]) * r.standard_normal(5), int(r.integers(4))) for i in range(300)]
    vectors = pd.DataFrame([("p", p, i, v, c) for p, i, v, c in rows], columns=["project_name", "path", "chunk_index", "embedding", "cell"])
    wants = [sorted(set(r.integers(0, 4, 3).tolist())) for _ in range(25)]
    queries = pd.DataFrame({"query_id": range(25), "query": [base[r.integers(40)] for _ in range(25)], "cells": wants})
    for limit in (1, 3, 100):
        got = vector._nearest_asked(vectors, queries, limit)
        plain = pd.concat(vector._nearest(vectors[vectors["cell"].isin(q.cells)], queries[queries["query_id"] == q.query_id], limit) for q in queries.itertuples())
        assert got.to_numpy().tolist() == plain.to_numpy().tolist()


def test_shelves_have_neighbouring_cells(spark, monkeypatch):
    monkeypatch.setattr(vector, "PART", 10)
    stats = spark.createDataFrame([("p", c, n) for c, n in enumerate([4, 4, 4, 25, 1])] + [("p", vector.NOWHERE, 3), (None, 0, 2)], "project_name string, cell int, rows long")
    found = {(s.project_name, s.cell): (s.shelf, s.parts) for s in vector.shelves(stats, 5).collect()}
    assert found[("p", vector.NOWHERE)][0] == vector.NOWHERE and found[(None, 0)] == (0, 1)
    assert found[("p", 0)][0] == found[("p", 1)][0] == 0 and found[("p", 3)][1] >= 3
