"""Alignment, repeated tracking and lineage tables in place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import align, tracking
from cellweave.operators import lineage as L
from cellweave.sources import forests


def direct(reference, there, plane, here, most):
    best = None
    for dy in range(-most, most + 1):
        for dx in range(-most, most + 1):
            pairs = [(reference[y + dy, x + dx], plane[y, x]) for y, x in np.argwhere(here) if 0 <= y + dy < there.shape[0] and 0 <= x + dx < there.shape[1] and there[y + dy, x + dx]]
            if pairs:
                key = (sum(a * b for a, b in pairs) / len(pairs), -(abs(dy) + abs(dx)), -dy, -dx)
                best = key if best is None or (key[0] - best[0] > 1e-12) or (abs(key[0] - best[0]) <= 1e-12 and key[1:] > best[1:]) else best
    return best and (-best[2], -best[3])


@pytest.mark.parametrize("seed", range(6))
def test_shifts_against_every_shift(seed):
    rng = np.random.default_rng(seed)
    planes = []
    for _ in range(2):
        have = rng.random((rng.integers(3, 12), rng.integers(3, 12))) < 0.7
        have[-1, -1] = True
        planes += [np.where(have, rng.integers(-4, 5, have.shape), 0).astype(float), have]
    assert align.best_shift(*planes, 5) == direct(*planes, 5) and align.best_shift(*planes, 32) == direct(*planes, 32)


def test_frames_that_moved_are_found(spark):
    rng = np.random.default_rng(1)
    scene = rng.random((90, 100))
    shifts = {"a": [(0, 0), (7, -3), (-32, 32)], "b": [(0, 0), (1, 1)]}
    rows = [(p, f + 2, y, x, float(scene[y + 40 - dy, x + 40 - dx] if 0 <= y + 40 - dy < 90 and 0 <= x + 40 - dx < 100 else 0.0)) for p, each in shifts.items() for f, (dy, dx) in enumerate(each) for y in range(40) for x in range(45)]
    got = align.best_shifts(spark.createDataFrame(rows, "position string, frame_i long, y long, x long, value double"), 32, ["position"]).collect()
    assert sorted(map(tuple, got)) == [("a", 3, -7, 3), ("a", 4, 32, -32), ("b", 3, -1, -1)]
    assert align.best_shifts(spark.createDataFrame([], "frame_i long, y long, x long, value double"), 2).count() == 0


def squares(spark, frames, position="p"):
    """One object a frame by (label, top, left), of 4 by 4 pixels; several a frame."""
    rows = [(position, f, t + i, e + k, label) for f, objects in enumerate(frames) for label, t, e in objects for i in range(4) for k in range(4)]
    return spark.createDataFrame(rows, "position string, frame_i long, y long, x long, label long")


def test_tracking_again_from_a_frame(spark):
    frames = [[(3, 0, 0), (8, 20, 20)], [(5, 0, 1), (8, 20, 21)], [(9, 0, 2), (2, 20, 20)], [(1, 1, 2), (4, 21, 20), (7, 40, 40)]]
    labels = squares(spark, frames).unionByName(squares(spark, frames[::-1], "q"))
    named = lambda df, p: {(r.frame_i, r.top, r.left): r.label for r in df.where(F.col("position") == p).groupBy("frame_i", "label").agg(F.min("y").alias("top"), F.min("x").alias("left")).collect()}
    got = named(tracking.repeat(labels, 2), "p")
    assert got == {(0, 0, 0): 3, (0, 20, 20): 8, (1, 0, 1): 5, (1, 20, 21): 8, (2, 0, 2): 5, (2, 20, 20): 8, (3, 1, 2): 5, (3, 21, 20): 8, (3, 40, 40): 9}
    for start in (0, 1, 2, 3):
        assert named(tracking.repeat(labels, start), "q") == named(tracking.track(labels, first_frame=max(0, start - 1)), "q")


def test_measuring_after_tracking_again(spark):
    frames = [[(3, 0, 0)], [(5, 0, 1)], [(9, 0, 2)]]
    pixels = squares(spark, frames).withColumn("value", F.col("x").cast("double"))
    out = tracking.repeat_and_measure({"g": pixels}, 2, 3, save=["mean"]).collect()
    assert sorted((r.frame_i, r.Cell_ID, r.g_mean, r.velocity_pixel) for r in out if r.frame_i == 2) == [(2, 5, 3.5, 1.0)] and {r.Cell_ID for r in out} == {3, 5}


def test_lineage_tables_change_where_they_are_edited(spark, tmp_path):
    folder = str(tmp_path / "forest")
    rows = [(p, f, c, f * 10 + c) for p in ("a", "b", "c") for f in (0, 1) for c in (1, 2, 3)]
    objects = spark.createDataFrame(rows, "position string, frame_i long, Cell_ID long, _row_id long")
    edits = lambda *x: spark.createDataFrame(list(x), "position string, frame_i long, Cell_ID long, parent_ID long")
    read = lambda df: {(r.position, r.frame_i, r.Cell_ID): (r.parent_ID_tree, r.generation_num_tree, r.root_ID_tree) for r in df.collect()}
    forests.write(forests.load_or_begin(objects.where("position <> 'c'"), folder), folder)
    stamps = lambda: {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "forest").glob("position=*/*.parquet")}
    before = stamps()
    first = read(forests.edit(objects, folder, edits(("a", 0, 2, 1), ("c", 1, 3, 2))))
    assert first["a", 0, 2] == (1, 2, 1) and first["c", 1, 3] == (2, 2, 2) and set(p for p, _, _ in first) == {"a", "c"}
    after = stamps()
    assert after["position=b"] == before["position=b"] and after["position=a"] != before["position=a"] and "position=c" in after
    again = forests.edit(objects, folder, edits(("a", 0, 3, 2)))
    assert read(again)["a", 0, 3] == (2, 3, 1) and read(again)["a", 0, 2] == (1, 2, 1)
    whole = read(forests.load_or_begin(objects, folder))
    assert len(whole) == 18 and whole["a", 0, 3] == (2, 3, 1) and whole["b", 0, 3] == (-1, 1, 3) and whole["c", 1, 3] == (2, 2, 2)


def test_a_tree_added_to_a_table(spark):
    cycles = [("a", 0, c, p, "bud" if p > 0 else "mother", 1, c) for c, p in ((1, -1), (2, 1), (3, 1), (4, 1))]
    df = spark.createDataFrame(cycles, "position string, frame_i long, Cell_ID long, relative_ID long, relationship string, generation_num long, _row_id long")
    out = {r.Cell_ID: r for r in forests.add_tree(df).collect()}
    assert (out[2].sister_ID_tree, out[2].sister_ID_tree_1, out[1].sister_ID_tree) == (3, 4, -1) and "sister_ID_tree_2" not in out[2].asDict()
    back = {r.Cell_ID: r.sisters for r in L.build(forests.add_tree(df)).collect()}
    assert back == {1: [], 2: [3, 4], 3: [2, 4], 4: [2, 3]}


def test_mappers_of_a_full_frame_meet_rows_by_id(spark):
    """No row carries all changes of its frame; ids that are missing, negative or not named stay."""
    ids = "frame_i long, Cell_ID long, relative_ID double, parent_ID_tree int"
    rows = [(f, c, float(c + 1) if c % 3 else -1.0, None if c % 5 == 0 else c - 7) for f in (0, 1) for c in range(300)]
    first = {(0, c): c + 1000 for c in range(0, 300, 2)} | {(1, 4): 6, (1, 6): 4, (0, -1): 77}
    second = {(0, c): 5 for c in range(0, 300, 3)}
    table = lambda m: spark.createDataFrame([(f, c, n) for (f, c), n in m.items()], "frame_i long, label long, new_label long")
    gone = spark.createDataFrame([(0, 8), (1, 299)], "frame_i long, label long")
    out = tracking.apply_mappers(spark.createDataFrame(rows, ids), table(first), table(second), gone)
    both = second | first
    new = lambda f, c: c if c is None or c < 0 else both.get((f, c), c)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((f, new(f, c), new(f, r), new(f, p)) for f, c, r, p in rows if (f, c) not in ((0, 8), (1, 299))), key=str)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
