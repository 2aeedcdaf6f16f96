"""Near-duplicate vectors against a plain comparison of all pairs."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from seekwell.llm import itq


def plain(rows, least=itq.LEAST):
    def good(row):
        return row[2] is not None and row[1] and all(x is not None and math.isfinite(x) for x in row[1]) and any(row[1])

    links, root = defaultdict(set), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if good(a) and good(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(v, float) / max(map(abs, v)) for v in (a[1], b[1]))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    links[i].add(j)
                    links[j].add(i)
                    root[find(i)] = find(j)
    out = []
    for i, row in enumerate(rows):
        names = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        first = min(names, default=None)
        out.append((row[0], len(links[i]), first, row[0] == first))
    return sorted(out, key=str)


def found(df, **more):
    got = itq.near_vectors(df, **more)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, got.collect()), key=str)


SCHEMA = "vec_id long, embedding array<double>, label int"


def some_vectors():
    r = np.random.default_rng(2)
    rows, bases = [], r.standard_normal((30, 16))
    for k, base in enumerate(bases):
        for _ in range(k % 5):
            rows.append((base + r.standard_normal(16) * r.choice([0.0, 0.05, 0.15]), k % 3))
    far = r.standard_normal((60, 16))
    rows += [(v, 1) for v in far]
    chain = [np.cos(t) * bases[0] + np.sin(t) * far[0] for t in np.arange(0, 1.5, 0.15)]  # ends are far apart
    rows += [(v, 2) for v in chain]
    rows = [(i, [float(x) for x in v], label) for i, (v, label) in enumerate(rows)]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [itq.HOT, 4])
def test_links_and_groups(spark, monkeypatch, hot):
    monkeypatch.setattr(itq, "HOT", hot)
    rows = some_vectors()
    v = rows[0][1]
    rows += [
        (500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [float("nan"), *v[1:]], 1), (504, [float("inf"), *v[1:]], 1), (505, [None, *v[1:]], 1),
        (506, v, None), (507, v, 77), (508, v[:5], rows[0][2]), (509, v[:5], rows[0][2]), (None, v, rows[0][2]), (None, v, 99), (None, v, 99),
        (510, [x * 1e300 for x in v], rows[0][2]), (511, [x * 1e-300 for x in v], rows[0][2]), (512, [-x for x in v], rows[0][2]),
        rows[1], rows[1], rows[1], (513, [0.0] * 15 + [3.0], 4), (514, [-0.0] * 15 + [1.0], 4),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.selectExpr("*", "1 AS id", "2 AS key", "3 AS many", "4 AS codes", "5 AS h", "6 AS part")
    want = [(a, b, c, True if a is None and c is None else bool(d)) for a, b, c, d in plain(rows)]
    assert found(clashing) == sorted(want, key=str)


def test_a_large_group_of_near_copies_is_met_by_parts(spark, monkeypatch):
    monkeypatch.setattr(itq, "HOT", 50)
    r = np.random.default_rng(7)
    base = r.standard_normal(32)
    rows = [(i, [float(x) for x in base + 0.08 * r.standard_normal(32)], 1) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(40)]
    got, want = found(spark.createDataFrame(rows, SCHEMA)), plain(rows)
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert [(g[0], g[2], g[3]) for g in got] == [(w[0], w[2], w[3]) for w in want]


def test_recall_of_pairs_close_to_the_least_cosine(spark):
    r = np.random.default_rng(11)
    rows = []
    for i in range(700):
        a, b = r.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        t = math.acos(0.981)
        rows += [(2 * i, [float(x) for x in a], i % 2), (2 * i + 1, [float(x) for x in math.cos(t) * a + math.sin(t) * b], i % 2)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert sum(n > 0 for _, n, _, _ in got) >= 0.9 * len(rows)
    assert all(c == v - v % 2 for v, n, c, _ in got if n)


def test_rotations_make_balanced_bits_and_lose_less_than_random_ones():
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 24)) * np.linspace(3, 0.2, 24) @ np.linalg.qr(r.standard_normal((24, 24)))[0]
    x -= x.mean(axis=0)
    loss = lambda turned: np.square(np.where(x @ turned >= 0, 1, -1) - x @ turned).sum()
    learnt, start = itq.learnt_rotation(x, 0), itq.learnt_rotation(x, 0, 0)
    assert np.allclose(learnt @ learnt.T, np.eye(24))
    assert loss(learnt) < loss(start)
    assert np.abs((x @ learnt >= 0).mean(axis=0) - 0.5).max() < 0.1


def test_tables_grow_with_the_input():
    for n in (1, 1000, 10**6, 10**10):
        width, tables = itq.plan(n)
        assert 1 - (1 - (1 - math.acos(0.98) / math.pi) ** width) ** tables >= 1 - itq.MISS
        assert width == 32 or n <= 1 << (width + 4)


def test_empty_tables_and_tables_without_links(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, None, 1)], SCHEMA)) == [(1, 0, 1, True)]
    assert found(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], SCHEMA)) == [(1, 0, 1, True), (2, 0, 2, True)]
