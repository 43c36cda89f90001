"""Exact search by pivots and rings against brute force in whole numbers."""

import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from cohortlens.llm import pivot_index

SCHEMA = "vec_id bigint, embedding array<float>, query_id int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def brute(rows, every=100, k=10):
    held = defaultdict(list)
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held[i].append([float(np.float32(x)) for x in v])
    held = {i: min(v) for i, v in held.items()}
    if not held:
        return []
    width = min(Counter(len(v) for v in held.values()).items(), key=lambda c: (-c[1], c[0]))[0]
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in held.items() if len(v) == width}
    out = []
    for q in whole:
        if q % every == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def got(spark, rows, **kw):
    return sorted(tuple(r) for r in pivot_index.search(frame(spark, rows), **kw).collect())


def clustered(count, seed=1, width=8, centres=40):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width)) * 3
    return [(int(i), (middle[rng.integers(centres)] + 0.05 * rng.normal(size=width)).tolist()) for i in rng.permutation(count)]


def test_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), (rng.normal(size=16) * rng.choice([0.1, 1, 30])).tolist()) for i in range(3000)]
    assert got(spark, rows, every=50) == brute(rows, every=50)


def test_copies_ties_and_odd_rows(spark):
    """A third of all rows are one vector; many scores are equal; some rows take no part."""
    rng = np.random.default_rng(2)
    rows = [(i, [0.5, -0.25, 1.0]) for i in range(400)] + [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(400, 1200)]
    rows += [(None, [1.0, 1.0, 1.0]), (1300, None), (1400, [1.0, None, 2.0]), (1500, [float("nan"), 1.0, 1.0]), (1600, [float("inf"), 0.0, 0.0]), (1700, [9.0]), (1800, []), (1900, [0.0, 0.0, 0.0]), (-100, [1.0, 1.0, -1.0]), (0, [9.0, 9.0, 9.0]), (0, [0.5, -0.25, 1.0])]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(100, None)], [(100, [1.0])], [(100, [1.0]), (200, [2.0]), (3, [-1.0])], [(0, []), (1, [])]])
def test_small_tables(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_products_beyond_what_doubles_hold_are_exact(spark):
    rows = [(i, [float(np.float32(x)) for x in (1e9 + 640 * i, 3e8 - 64 * i, 1.0 + i)]) for i in range(0, 300)] + [(1000, [1e20, 1.0, 1.0])]
    assert got(spark, rows) == brute(rows)


def test_bounds_hold_and_exclude_most_of_what_is_clustered(spark):
    rows = clustered(20_000)
    x = np.floor(np.array([v for _, v in rows], np.float32).astype(float) * 1024)
    pivots = pivot_index.fit_pivots(x[:2000], 64)
    label, far = pivot_index.distances(x, pivots).argmin(1), pivot_index.distances(x, pivots).min(1)
    units = sorted(set(label.tolist()))
    rings = pivot_index.Rings(pivots, units, units, [far[label == p].min() for p in units], [far[label == p].max() for p in units], [(x[label == p] ** 2).sum(1).max() for p in units])
    bound, real = rings.bounds(x[:200]), x[:200] @ x.T
    best = np.stack([real[:, label == p].max(1) for p in units], axis=1)
    assert (bound >= best).all()
    tenth = np.sort(real, axis=1)[:, -11]
    assert (bound >= tenth[:, None]).mean() < 0.2  # the share of rings that a query has to visit
    assert got(spark, rows, every=500) == brute(rows, every=500)


def test_queries_in_several_parts_and_vectors_in_several_bins(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "QUERY_BLOCK", 7)
    monkeypatch.setattr(pivot_index, "BLOCKS", (16, 16))
    rows = clustered(1500, centres=2)
    assert got(spark, rows, every=20) == brute(rows, every=20)


def test_sql_equals_brute_force():
    rows = clustered(700) + [(800, None), (900, [1.0, None] * 4), (0, [0.0] * 8), (None, [1.0] * 8)]
    con = duckdb.connect()
    con.sql("create table embeddings(vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    names = [d[0] for d in con.sql(pivot_index.SQL).description]
    assert sorted(tuple(r[names.index(c)] for c in ("query_id", "rank", "vec_id", "score")) for r in con.sql(pivot_index.SQL).fetchall()) == brute(rows)
