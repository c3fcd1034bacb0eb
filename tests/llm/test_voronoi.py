"""The Voronoi join and its blocks against brute force."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyvox.llm import vectors, voronoi

SCHEMA = "vec_id long, embedding array<float>, label int, id string, cell int, score double"


def whole(vector):
    """floor(256 * x) by exact fractions; None if the vector takes no part."""
    if vector is None or any(x is None or x != x or abs(x) == float("inf") for x in vector):
        return None
    return [(256 * Fraction(x)).__floor__() for x in vector]


def inner(a, b):
    return sum(x * y for x, y in zip(a, b))


def key_order(vec_id):
    return vec_id is None, vec_id or 0


def brute(rows, every, k):
    """{query: [(vec_id, score)]} of (vec_id, vector) rows."""
    points = [(i, whole(v)) for i, v in rows]
    points = [(i, v) for i, v in points if v is not None]
    asked = {}
    for i, v in points:
        if i is not None and i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    return {
        q: sorted(
            ((i, inner(v, w)) for i, w in points if i != q), key=lambda found: (-found[1], key_order(found[0]))
        )[:k]
        for q, v in asked.items()
    }


def clustered(seed, n, width):
    """A few tight clusters far apart, with rows on the same spot: the bounds have something to prune."""
    draw = random.Random(seed)
    centres = [[draw.uniform(-4, 4) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        centre = draw.choice(centres)
        rows.append((i, [float(np.float32(c + draw.gauss(0, 0.01 * (i % 3)))) for c in centre]))
    return rows


ODD = [
    (None, [0.5, 0.5]), (None, None), (0, [1.0, 0.25]), (5, []), (10, [1.0, None]), (15, [float("nan"), 1.0]),
    (20, [float("inf"), 1.0]), (25, None), (30, [-1.0, -0.001]), (35, [0.5]), (40, [1.0, 0.25]), (41, [1.0, 0.25]),
    (41, [1.0, 0.25]), (45, [0.0, 0.0]), (45, [0.0, 0.0]), (50, [0.1, 0.2, 0.3]), (-5, [-0.3, 0.7]),
]


def frame(spark, rows, partitions=3):
    """With extra columns whose names clash with those inside."""
    full = [(i, v, 1, f"x{i}", n, 0.5) for n, (i, v) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def found(frame_, every, k):
    got = {}
    rows = voronoi.top_k(frame_, F.col("vec_id") % every == 0, k).collect()
    for row in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        mine = got.setdefault(row.query_id, [])
        mine.append((row.vec_id, row.score))
        assert row["rank"] == len(mine)
    return got


def test_odd_rows(spark):
    """Nulls, non-finite components, ragged and empty vectors, repeats, ties, clashing names."""
    for k in (1, 3, 40):
        assert found(frame(spark, ODD), 5, k) == {q: b for q, b in brute(ODD, 5, k).items() if b}


def test_empty_tables(spark):
    empty = voronoi.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0)
    assert empty.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert empty.count() == 0
    assert found(frame(spark, [(1, [1.0]), (2, [2.0])]), 5, 3) == {}  # no query
    assert found(frame(spark, [(0, [1.0])]), 5, 3) == {}  # no candidate


def test_clusters_by_many_small_groups_and_slices(spark, monkeypatch):
    """Small blocks, groups and slices: pruning, splitting and merging all take part."""
    monkeypatch.setattr(voronoi, "GROUP_ROWS", 4)
    monkeypatch.setattr(voronoi, "PIVOTS", 8)
    monkeypatch.setattr(vectors, "SLICE_VALUES", 300)
    rows = clustered(3, 600, 3)
    rows += [(i, rows[7][1]) for i in range(600, 900)]  # a third of all rows on one spot
    assert found(frame(spark, rows), 25, 5) == brute(rows, 25, 5)


def test_bounds_keep_what_is_needed_and_prune():
    draw = np.random.default_rng(5)
    centres = draw.normal(0, 1000, (6, 4))
    matrix = np.round(np.concatenate([c + draw.normal(0, 20, (50, 4)) for c in centres]))
    cells = voronoi.Cells(centres)
    cell, figures = cells(matrix)
    assert (cell == np.repeat(np.arange(6), 50)).all()

    def summary(rows):
        table = np.array([[r.sum(), *figures[r].min(0), *figures[r].max(0)] for r in (rows & (cell == c) for c in range(6))])
        return dict(zip(("rows", "near", "short", "far", "long"), table.T))

    everyone = np.ones(len(matrix), bool)
    k = 5
    bounds = voronoi.Bounds(centres, summary(everyone), summary(everyone), k + 1)
    scores = matrix @ matrix.T
    np.fill_diagonal(scores, -np.inf)
    best = np.argsort(-scores, axis=1)[:, :k]
    sent = 0
    for c in range(6):
        one = figures[cell == c]
        needed = bounds(c, *one.min(0), *one.max(0))
        sent += needed.sum()
        for q in range(len(matrix)):
            if (cell[best[q]] == c).any():
                assert needed[cell[q]]
    assert sent < 36  # of all pairs of cells


def test_products_beyond_doubles_are_exact(spark):
    big = [(0, [2.0**40, 1.0, -(2.0**40)]), (1, [2.0**40, 3.0, 2.0**40]), (2, [2.0**40, 2.0, 2.0**40]), (3, [2.0**90, 0.0, 0.0])]
    want = brute(big, 5, 5)
    got = found(frame(spark, big), 5, 5)
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]] == [3, 1, 2]
    assert got[0][0][1] == (1 << 63) - 1 and got[0][1:] == want[0][1:]


@pytest.mark.parametrize("limit", [(1 << 15) - 1, 1 << 15, 1 << 31, 1 << 45])
def test_packed_vectors_come_back(limit):
    matrix = np.array([[limit, -limit, 0.0], [1, 2, 3]])
    table = pa.table(
        {"n": [2], "width": [3], "ids": [np.arange(2).tobytes()], "labels": [np.arange(2).tobytes()], "vectors": [vectors._packed(matrix)]}
    )
    (ids, labels, back), = vectors.unpacked(table)
    assert ids.tolist() == labels.tolist() == [0, 1] and (back == matrix).all()


def test_best_takes_ties_by_column():
    draw = random.Random(2)
    scores = np.array([[float(draw.randrange(4)) for _ in range(9)] for _ in range(50)])
    for k in (1, 3, 9, 12):
        got = voronoi.best(scores, k)
        assert got.tolist() == [sorted(range(9), key=lambda c: (-row[c], c))[:k] for row in scores.tolist()]
        assert voronoi.best(scores.astype(object), k).tolist() == got.tolist()


def test_share_out():
    first, parts, total = vectors.share_out(np.array([3, 0, 9, 2, 1]), 4, [0, 4, 3, 2])
    assert (first.tolist(), parts.tolist(), total) == ([0, 0, 2, 1, 0], [1, 1, 3, 1, 1], 5)
