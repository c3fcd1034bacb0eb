"""Hard negatives and the tree against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tallyvox.llm import rtree, vectors
from tests.llm.test_voronoi import ODD, clustered, inner, key_order, whole

SCHEMA = "vec_id long, embedding array<double>, label int, id string, place int, rank int"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every, positives=5, negatives=10, lowest=30, highest=90):
    """All rows of the result, of (vec_id, vector, label) rows."""
    points = [(i, whole(v), c) for i, v, c in rows]
    points = [(i, v, c) for i, v, c in points if v is not None and c is not None]
    anchors = {}
    for i, v, c in points:
        if i is not None and i % every == 0:
            anchors[i] = min(anchors.get(i, (c, v)), (c, v))
    found = []
    for a, (label, v) in anchors.items():
        scored = sorted(((-inner(v, w), key_order(i), i, c) for i, w, c in points), key=lambda s: s[:2])
        near = [(i, -s) for s, _, i, c in scored if c == label and i != a][:positives]
        for positive, most in near:
            far = [(i, -s) for s, _, i, c in scored if c != label and lowest * most <= -100 * s <= highest * most]
            found += [(a, positive, n + 1, i, most, s) for n, (i, s) in enumerate(far[:negatives])]
    return sorted(found, key=repr)


def found(spark, rows, every, partitions=3, **options):
    full = [(i, v, c, f"x{i}", n, n) for n, (i, v, c) in enumerate(rows)]
    frame = spark.createDataFrame(full, SCHEMA).repartition(partitions)
    out = rtree.hard_negatives(frame, F.col("vec_id") % every == 0, **options)
    return sorted((tuple(r) for r in out.select(*NAMES).collect()), key=repr)


def test_odd_rows(spark):
    """Nulls in any column, non-finite components, ragged and empty vectors, repeats, ties."""
    rows = [(i, v, [0, 1, None, 0][n % 4]) for n, (i, v) in enumerate(ODD)]
    rows += [(i, v, 2) for i, v in ODD] + [(100 + i, [0.1 * i, 0.5], i % 3) for i in range(30)]
    rows += [(200, [0.4, 0.5], 1)] * 5
    want = brute(rows, 5)
    assert want and found(spark, rows, 5) == want
    options = {"positives": 2, "negatives": 3, "lowest": -50, "highest": 100}
    assert found(spark, rows, 5, **options) == brute(rows, 5, **options)


def test_empty_tables(spark):
    empty = rtree.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0)
    kinds = {"rank": "int"}
    assert empty.dtypes == [(n, kinds.get(n, "bigint")) for n in NAMES] and empty.count() == 0
    assert found(spark, [(1, [1.0], 0)], 5) == []
    assert found(spark, [(0, [1.0], 0), (1, [1.0], 1)], 5) == []  # no positive


def test_many_small_tiles_blocks_pages_and_slices(spark, monkeypatch):
    monkeypatch.setattr(rtree, "TILE_ROWS", 40)
    monkeypatch.setattr(rtree, "GROUP_ROWS", 7)
    monkeypatch.setattr(rtree, "SLICE_VALUES", 400)
    monkeypatch.setattr(vectors, "BLOCK_VALUES", 60)
    rows = [(i, v, (i * i) % 3) for i, v in clustered(4, 500, 3)]
    rows += [(i, rows[11][1], i % 2) for i in range(500, 750)]  # a third of all rows on one spot
    want = brute(rows, 20)
    assert len(want) > 500 and found(spark, rows, 20) == want


def test_pages_hold_each_row_once_and_are_tight():
    matrix = np.random.default_rng(1).normal(0, 100, (5000, 3)).round()
    order = rtree.pages(matrix)
    assert sorted(order.tolist()) == list(range(5000))

    def volume(order):
        leaves = rtree.Leaves(order, order, matrix[order])
        return np.prod(leaves.high - leaves.low, axis=1).sum()

    assert volume(order) < volume(np.arange(5000)) / 10


def test_tiles_are_even_and_know_every_vector():
    matrix = np.random.default_rng(2).normal(0, 100, (8000, 5)).round()
    tiles = rtree.Tiles(matrix[:2000], 27)
    cells, _ = tiles(matrix)
    sizes = np.bincount(cells, minlength=27)
    assert len(sizes) == 27 and sizes.min() > 150 and sizes.max() < 600
    assert (tiles(np.full((4, 5), 1e9))[0] == 26).all()
    flat = rtree.Tiles(np.ones((100, 2)), 8)  # one spot
    assert len(np.unique(flat(np.ones((10, 2)))[0])) == 1


def test_search_prunes_boxes():
    """Scores are in the boxes' ranges, and far fewer pages are opened than there are."""
    draw = np.random.default_rng(3)
    centres = draw.normal(0, 400, (40, 2))
    matrix = np.concatenate([c + draw.normal(0, 5, (500, 2)) for c in centres]).round()
    matrix = matrix[rtree.pages(matrix)]
    ids = np.arange(len(matrix))
    leaves = rtree.Leaves(ids, ids % 2, matrix)
    opened = []
    page = leaves.page
    leaves.page = lambda i, query: opened.append(i) or page(i, query)
    top = rtree.Box(leaves.low.min(0, keepdims=True), leaves.high.max(0, keepdims=True))
    for query in draw.normal(0, 300, (20, 2)).round():
        least, most = leaves.boxes.ranges(query)
        scores = matrix @ query
        of = np.repeat(np.arange(len(least)), rtree.PAGE)[: len(scores)]
        assert (least[of] <= scores).all() and (scores <= most[of]).all()
        opened.clear()
        high = float(np.quantile(scores, 0.7))
        windows = [rtree.ScoreWindow(-np.inf, np.inf, 3), rtree.ScoreWindow(high / 2, high, 4)]
        rtree.search([leaves], top, query, windows, lambda i, c: c == 1)
        for window in windows:
            fits = [i for i in np.lexsort((ids, -scores)) if i % 2 and window.low <= scores[i] <= window.high]
            assert sorted(-i for _, i in window.heap) == sorted(fits[: window.k])
        assert len(opened) == len(set(opened)) < len(least) / 2
