"""Tiled and whole planes agree."""

import numpy as np
import pytest

from cellweave.operators import planes, segment, tiles
from cellweave.operators.unions import united


def plane(spark, *masks):
    rows = [(f, int(y), int(x), int(m[y, x])) for f, m in enumerate(masks) for y, x in np.argwhere(m > 0)]
    return spark.createDataFrame(rows, "frame_i long, y long, x long, label long")


def test_components_of_edges(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in united(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in root}
    assert united(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("tile", [1, 4, 100])
def test_parts_over_tiles(spark, tile):
    rng = np.random.default_rng(2)
    masks = [rng.random((13, 17)) < p for p in (0.55, 0.65)]
    spiral = np.zeros((11, 11), bool)
    spiral[::2], spiral[1::4, -1], spiral[3::4, 0] = True, True, True
    masks.append(spiral)
    got = tiles.parts(plane(spark, *(m.astype(int) for m in masks)), tile=tile).collect()
    for f, mask in enumerate(masks):
        whole, seen = planes.parts_of(mask), {}
        for r in (r for r in got if r.frame_i == f):
            seen.setdefault(r.part, set()).add(int(whole[r.y, r.x]))
        assert all(len(s) == 1 for s in seen.values()) and len(seen) == whole.max() and sum(r.frame_i == f for r in got) == mask.sum()


def test_segments_in_reading_order(spark):
    values = np.random.default_rng(3).random((14, 15))
    rows = [(0, y, x, float(values[y, x])) for y, x in np.ndindex(values.shape)]
    pixels = spark.createDataFrame(rows, "frame_i long, y long, x long, value double")
    whole = segment.segment(pixels, segment.threshold_segmenter(0.45)).collect()
    assert sorted(map(tuple, tiles.segment_above(pixels, 0.45, tile=5).collect())) == sorted((r.frame_i, r.y, r.x, r.label) for r in whole)


@pytest.mark.parametrize("tile", [3, 64])
def test_holes_over_tiles(spark, tile):
    rng = np.random.default_rng(4)
    ragged = (rng.random((16, 18)) < 0.6).astype(int) * 7
    nested = np.zeros((15, 15), int)
    nested[1:14, 1:14] = 2
    nested[2:13, 2:13] = 0
    nested[4:11, 4:11] = 1
    nested[6:9, 6:9] = 0
    nested[7, 7] = 3
    labels = plane(spark, ragged, nested, nested.max() - nested)
    whole = planes.fill_holes(labels).collect()
    assert sorted(map(tuple, tiles.fill_holes(labels, tile=tile).collect())) == sorted((r.frame_i, r.y, r.x, r.label) for r in whole)


def test_labels_that_fit_a_tile_are_filled_whole(spark, monkeypatch):
    """Thousands of small labels took a task's call for each of them and tile; they are filled together, in batches that cut labels."""
    rng = np.random.default_rng(5)
    rows = [(f, 12 * (k % 4) + y, 12 * (k // 4) + x, k + 1) for f in range(6) for k in range(16) for y, x in np.argwhere(rng.random((12, 12)) < 0.55).tolist()]
    labels = spark.createDataFrame(rows, "frame_i long, y long, x long, label long")
    monkeypatch.setattr(tiles, "parts", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = tiles.fill_holes(labels, tile=16).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = planes.fill_holes(labels).collect()
    assert len(got) > len(rows) and sorted((r.frame_i, r.y, r.x, r.label) for r in got) == sorted((r.frame_i, r.y, r.x, r.label) for r in whole)
