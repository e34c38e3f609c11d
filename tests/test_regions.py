"""Regions, orders, backgrounds and measuring in depth, against plain loops and numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import annotations as A
from cellweave.operators import areas, objects
from cellweave.operators.order import numbered
from cellweave.plans import workflow as W
from cellweave.operators import segment as S
from cellweave.sources import layout

ROI = "position string, roi_id long, top long, left long, bottom long, right long"


def image(spark, values, labels=None, position="Position_1"):
    """Arrays (t, y, x) or (t, z, y, x) as pixels."""
    axes = ["frame_i", "y", "x"] if values.ndim == 3 else ["frame_i", "z", "y", "x"]
    labels = np.zeros(values.shape, int) if labels is None else labels
    rows = [(position, *map(int, at), float(values[at]), int(labels[at])) for at in np.ndindex(values.shape)]
    return spark.createDataFrame(rows, f"position string, {', '.join(f'{a} long' for a in axes)}, value double, label long")


def test_regions_of_any_size_meet_their_pixels(spark):
    r = random.Random(1)
    values = np.arange(2 * 30 * 40).reshape(2, 30, 40)
    rois = [("Position_1", i, (t := r.randrange(-5, 35)), (l := r.randrange(-5, 45)), t + r.randrange(-2, 25), l + r.randrange(-2, 30)) for i in range(25)]
    got = areas.in_regions(image(spark, values), spark.createDataFrame(rois, ROI), square=7).select("roi_id", "frame_i", "y", "x").collect()
    want = [(i, f, y, x) for _, i, t, l, b, e in rois for f in range(2) for y in range(max(t, 0), min(b, 30)) for x in range(max(l, 0), min(e, 40))]
    assert sorted(map(tuple, got)) == sorted(want)
    assert areas.in_regions(image(spark, values), spark.createDataFrame([], ROI)).count() == 0


def test_cut_out_images_start_at_their_corner(spark):
    rois = spark.createDataFrame([("Position_1", 3, -2, 4, 2, 6), ("Position_9", 1, 0, 0, 9, 9)], ROI)
    got = areas.crop_regions(image(spark, np.arange(48).reshape(1, 6, 8)), rois).select("roi_id", "y", "x", "value").collect()
    assert sorted(map(tuple, got)) == [(3, 0, 0, 4.0), (3, 0, 1, 5.0), (3, 1, 0, 12.0), (3, 1, 1, 13.0)]


def test_new_positions_and_clipped_regions(spark):
    rois = spark.createDataFrame([("Position_2", 0, 0, 0, 5, 5), ("Position_10", 1, 0, 0, 5, 5), ("Position_10", 0, 2, 3, 9, 9), ("Position_3", 4, 0, 0, 1, 1), ("Position_3", 7, 0, 0, 1, 1)], ROI)
    placed = areas.new_positions(rois, spark.createDataFrame([(f"Position_{i}",) for i in (2, 3, 10, 12)] + [("other",)], "position string"))
    assert {(r.position, r.roi_id): r.target for r in placed.collect()} == {("Position_2", 0): "Position_2", ("Position_3", 4): "Position_13", ("Position_3", 7): "Position_14", ("Position_10", 0): "Position_15", ("Position_10", 1): "Position_16"}
    inner = spark.createDataFrame([("Position_10", 0, 4, 4, 6, 20), ("Position_10", 1, 0, 0, 2, 3)], "position string, n long, top long, left long, bottom long, right long")
    got = areas.clipped(inner, placed.where("position = 'Position_10'")).collect()
    assert sorted(map(tuple, got)) == [("Position_15", 0, 2, 1, 4, 6), ("Position_16", 0, 4, 4, 5, 5), ("Position_16", 1, 0, 0, 2, 3)]


def test_numbering_over_ranges(spark):
    names = [random.Random(i).randrange(10**6) for i in range(5000)] + [5] * 50
    got = numbered(spark.createDataFrame([(n,) for n in names], "v long").repartition(7), ["v"]).orderBy("n").collect()
    assert [r.v for r in got] == sorted(names) and [r.n for r in got] == list(range(1, len(names) + 1))
    assert numbered(spark.createDataFrame([], "v long"), ["v"]).count() == 0


def test_backgrounds_of_regions_archives_and_a_second_image(spark):
    rng = np.random.default_rng(3)
    values, labels = rng.integers(1, 99, (3, 12, 14)).astype(float), np.zeros((3, 12, 14), int)
    labels[:, 2:6, 3:8], labels[:, 8:11, 9:13] = 1, 2
    pixels = image(spark, values, labels)
    rois = spark.createDataFrame([("Position_1", 0, 0, 0, 5, 6), ("Position_1", 1, 3, 4, 20, 20)], ROI)
    archive = spark.createDataFrame([("Position_1", 1, float(v)) for v in (3, 9, 30)], "position string, frame_i long, value double")
    second = np.zeros_like(labels)
    second[:, 0:2, 0:3] = 1
    got = {(r.frame_i, r.Cell_ID): r for r in objects.measure({"g": pixels}, 3, keys=["position"], rois=rois, archives={"g": archive}, manual=image(spark, values, second).drop("value"), sizes=["cell_area_um2"], regionprops=[]).collect()}
    inside = np.zeros((12, 14), bool)
    inside[0:5, 0:6], inside[3:, 4:] = True, True
    for (f, c), r in got.items():
        own, free = values[f][labels[f] == c], values[f][labels[f] == 0]
        regional = np.array([3, 9, 30]) if f == 1 else values[f][inside & (labels[f] == 0)]
        under = values[f][second[f] == c]
        for name, v in (("autoBkgr", free), ("dataPrepBkgr", regional), *([("manualBkgr", under)] if c == 1 else [])):
            for level, q in (("median", 50), ("q05", 5), ("q25", 25), ("q75", 75), ("q95", 95)):
                assert r[f"g_{name}_bkgrVal_{level}"] == pytest.approx(np.percentile(v, q))
            assert r[f"g_{name}_bkgrVal_mean"] == pytest.approx(v.mean())
            assert r[f"g_amount_{name}"] == pytest.approx((own.mean() - (v.mean() if name == "manualBkgr" else np.median(v))) * own.size)
        if c == 2:
            assert np.isnan(r["g_manualBkgr_bkgrVal_median"]) and np.isnan(r["g_amount_manualBkgr"])
        else:
            assert r["g_mean_manualBkgr"] == pytest.approx(own.mean() - under.mean())
        assert r["g_concentration_dataPrepBkgr_from_vol_fl"] != 0 and "cell_vol_fl" not in r.asDict() and "perimeter" not in r.asDict() and "cell_area_um2" in r.asDict()
    assert len(got) == 6


def test_measuring_in_depth(spark):
    rng = np.random.default_rng(4)
    values, labels = rng.integers(1, 60, (2, 4, 6, 7)).astype(float), np.zeros((2, 4, 6, 7), int)
    labels[:, 1:3, 1:4, 1:5], labels[1, 3, 4:6, 2:6] = 1, 2
    voxels = image(spark, values, labels)
    flat = voxels.where("label <> 0").groupBy("position", "frame_i", "y", "x").agg(F.max_by("label", "z").alias("label"))
    parts = objects.variants(voxels.drop("label"), flat, 2, ["position"], labels_3d=voxels.where("label <> 0"))
    got = {(r.frame_i, r.Cell_ID): r for r in objects.measure({"g": parts}, 2, size_z=2.0, size_y=0.5, size_x=0.25, keys=["position"], slice_count=4).collect()}
    assert set(got) == {(0, 1), (1, 1), (1, 2)}
    for (f, c), r in got.items():
        own, free = values[f][labels[f] == c], values[f][labels[f] == 0]
        assert (r["cell_vol_vox_3D"], r["cell_vol_fl_3D"]) == (own.size, own.size * 0.25)
        assert r["g_mean_3D"] == pytest.approx(own.mean()) and r["g_q95_3D"] == pytest.approx(np.percentile(own, 95))
        amount = (own.mean() - np.median(free)) * own.size
        assert r["g_amount_autoBkgr_3D"] == pytest.approx(amount) and r["g_concentration_autoBkgr_from_vol_fl_3D"] == pytest.approx(amount / (own.size * 0.25))
        assert [r[f"cell_area_pxl_zslice{z}"] for z in range(4)] == [(labels[f, z] == c).sum() for z in range(4)]
        shape = (labels[f] == c).any(axis=0)
        assert r["g_max_maxProj"] == values[f].max(axis=0)[shape].max() and r["g_sum_zSlice"] == pytest.approx(values[f, 2][shape].sum())


def test_plans_hold_only_what_is_wanted(spark):
    pixels = image(spark, np.ones((1, 4, 4)), np.ones((1, 4, 4), int))
    out = objects.measure({"g": pixels}, 1, keys=["position"], sizes=[], regionprops=["eccentricity"], save=["mean"])
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString() and {"perimeter", "cell_vol_vox", "velocity_pixel", "g_sum"}.isdisjoint(out.columns)
    assert {"eccentricity", "g_mean", "disappears_before_end"} <= set(out.columns)


def test_disappearing_at_each_positions_last_frame(spark):
    rows = spark.createDataFrame([(p, f, c) for p in "ab" for f in range(3) for c in (1, 2) if not (c == 2 and f == 2)], "position string, frame_i long, label long")
    ends = spark.createDataFrame([("a", 3), ("b", 2)], "position string, n_frames long")
    gone = objects.disappearances(rows.join(ends, "position").where("frame_i < n_frames").drop("n_frames"), ends, ["position"]).where("disappears_before_end = 1").collect()
    assert [(r.position, r.frame_i, r.label) for r in gone] == [("a", 1, 2)]


WORKFLOW = """
[workflow]
type = {kind}
do_tracking = {track}
[paths_info]
paths = p1, p2
stop_frame_numbers = 2, -1
[standard_postprocess_features]
min_area = 2
"""


def test_workflows_by_position(spark):
    values = np.zeros((3, 5, 6))
    values[:, 1:3, 1:3], values[:, 4, 5] = 9, 9
    both = image(spark, values, position="p1").unionByName(image(spark, values, position="p2")).drop("label")
    found = W.run_segmentation(W.parse(WORKFLOW.format(kind="segmentation and/or tracking", track="yes")), both, S.threshold_segmenter(5.0))
    assert sorted({(r.position, r.frame_i) for r in found.collect()}) == [("p1", 0), ("p1", 1), ("p2", 0), ("p2", 1), ("p2", 2)] and found.count() == 5 * 4
    plan = W.parse(WORKFLOW.format(kind="measurements", track="no"))
    pixels = both.join(found, ["position", "frame_i", "y", "x"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    out = W.run_measurements(plan, {"g": pixels}, 3).collect()
    assert sorted((r.position, r.frame_i, r.disappears_before_end) for r in out) == [("p1", 0, 0), ("p1", 1, 0), ("p2", 0, 0), ("p2", 1, 0), ("p2", 2, 0)]
    with pytest.raises(Exception, match="no path of the workflow: p3"):
        W.run_measurements(plan, {"g": pixels.unionByName(pixels.where("position = 'p1'").withColumn("position", F.lit("p3")))}, 3).collect()
    with pytest.raises(W.WorkflowError):
        W.run_segmentation(plan, both, S.threshold_segmenter(5.0))


def test_cycles_that_do_not_go_on(spark):
    rows = [(0, 0, 1, 1, "G1", 1), (0, 1, 1, 2, "G1", 1), (0, 0, 2, 1, "S", 0), (0, 0, 3, 1, "S", 1), (1, 0, 1, 3, "G1", 1)]
    df = spark.createDataFrame(rows, "position long, frame_i long, Cell_ID long, generation_num long, cell_cycle_stage string, will_divide long")
    name = "will_divide without next generation"
    assert sorted(tuple(r) for r in A.integrity_of_cycles(df).where(F.col("category") == name).collect()) == [(0, name, 1, 2), (0, name, 3, 1), (1, name, 1, 3)]
    assert {r.category for r in A.integrity_of_cycles(df.drop("will_divide")).collect()} == {"cycles without G1"}


def test_layouts_of_imports(spark):
    table = lambda *names: spark.createDataFrame([(f"/a/{n}",) for n in names], "path string")
    plan = lambda df, *a, **k: sorted((r.path[3:], r.position, r.channel, r.frame_i) for r in layout.import_plan(df, *a, **k).collect())
    assert plan(table("b10.tif", "b2.tif")) == [("b10.tif", "Position_2", "channel_0", None), ("b2.tif", "Position_1", "channel_0", None)]
    files = table("s2_g_9.tif", "s2_g_10.tif", "s10_g_1.tif")
    assert plan(files, "file per frame") == [("s10_g_1.tif", "Position_2", "g", 0), ("s2_g_10.tif", "Position_1", "g", 1), ("s2_g_9.tif", "Position_1", "g", 0)]
    own = plan(table("t03-w2-gfp.tif", "t1-w2-gfp.tif", "t1-w1-bf.tif", "notes.tif"), "custom", pattern=r"^t(?P<frame>\d+)-(?P<position>w\d+)-(?P<channel>\w+)$")
    assert own == [("t03-w2-gfp.tif", "Position_2", "gfp", 1), ("t1-w1-bf.tif", "Position_1", "bf", 0), ("t1-w2-gfp.tif", "Position_2", "gfp", 0)]
    for wrong in ({"layout": "none"}, {"layout": "custom", "pattern": "(a)"}):
        with pytest.raises(ValueError):
            layout.import_plan(files, **wrong)
