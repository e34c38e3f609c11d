"""Label-image operators on small literal images."""

import io
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import lineage as L
from cellweave.operators import objects as O
from cellweave.operators import pixels as X
from cellweave.operators import planes as N
from cellweave.operators import render as D
from cellweave.operators import segment as S
from cellweave.operators import tracking as K
from cellweave.plans import workflow as W
from cellweave.sources import arrays as R
from cellweave.sources import layout as Y
from cellweave.sources import sidecars as C
from cellweave.sources import tables as T


def image(spark, frames, z=False):
    """Frames (or slices) as lists of digit rows."""
    out = [(t, y, x, int(c)) for t, frame in enumerate(frames) for y, row in enumerate(frame) for x, c in enumerate(row)]
    df = spark.createDataFrame(out, "frame_i long, y long, x long, label long")
    return df.withColumn("z", F.col("frame_i")).withColumn("frame_i", F.lit(0).cast("long")) if z else df


def back(df, shape, axis="frame_i"):
    a = np.zeros(shape, int)
    for r in df.collect():
        a[r[axis], r.y, r.x] = r.label
    return [["".join(map(str, row)) for row in f] for f in a]


def tracked(spark, frames, **options):
    df = image(spark, frames).withColumn("position", F.lit(0))
    return back(K.track(df, **options), (len(frames), len(frames[0]), len(frames[0][0])))


def test_counts_coordinates_and_points(spark):
    assert X.object_counts(image(spark, [["011", "002"], ["011", "033"]])).first().unique_objects == 3
    coords = [tuple(r) for r in X.coordinates(image(spark, [["01", "22"], ["30", "30"]])).collect()]
    assert len(coords) == 5 and (1, 3, 1, 0) in coords
    m = image(spark, [["11", "22"], ["33", "00"]])
    points = spark.createDataFrame([(0, 0, 0)], "frame_i long, y long, x long")
    assert back(X.filter_by_points(m, points), (2, 2, 2)) == [["11", "00"], ["00", "00"]]


def test_holes_and_depth(spark):
    assert back(N.fill_holes(image(spark, [["111", "101", "111"]])), (1, 3, 3)) == [["111"] * 3]
    assert back(N.fill_holes(image(spark, [["11111", "10001", "10201", "10011", "11101"]])), (1, 5, 5)) == [["11111", "11111", "11111", "11111", "11101"]]
    assert back(X.connect_3d(image(spark, [["01", "00"], ["00", "01"]], z=True)), (2, 2, 2), "z") == [["00", "01"], ["00", "01"]]
    assert X.stack_to_3d(image(spark, [["01", "23"]]), 3).count() == 12
    v = spark.createDataFrame([(0, z, 0, x, float(v)) for z, x, v in ((0, 0, 1), (0, 1, 3), (1, 0, 5), (1, 1, 7))], "frame_i long, z long, y long, x long, value double")
    show = lambda d: [r.value for r in d.orderBy("x").collect()]
    assert show(X.project(v, "single", 1)) == [5, 7] and show(X.project(v, "mean")) == [3, 5] and show(X.project(v, "median")) == [5, 7]


def test_tracking(spark):
    step = [["1100", "1100", "0000", "0000"], ["0220", "0220", "0000", "0000"]]
    assert tracked(spark, step)[1][0] == "0110"
    assert tracked(spark, [["1100", "1100"], ["2211", "2211"]]) == [["1100", "1100"], ["1133", "1133"]]
    empty = [["0000", "0000"], ["1122", "1122"]]
    assert tracked(spark, empty)[1] == ["3344", "3344"] and tracked(spark, empty, unique_new=False)[1] == ["1122", "1122"]
    pair = [["110", "110", "000"], ["222", "202", "002"]]
    rows = lambda d: [tuple(r)[1:3] for r in K.assignments(image(spark, pair), 0.6, denominator=d).collect()]
    assert rows("area_prev") == [(2, 1)] and rows("union") == []
    gone = K.disappeared(image(spark, [["1122"], ["1111"]]).withColumn("position", F.lit(0))).collect()
    assert [(r.frame_i, r.label) for r in gone] == [(0, 2)]


def test_tracking_agrees_with_the_relational_step(spark):
    rng = np.random.default_rng(4)
    for trial in range(3):
        frames = rng.integers(0, 5, (2, 6, 6))
        frames[1][frames[1] > 0] += 4
        text = [["".join(map(str, r)) for r in f] for f in frames]
        step = {(r.old_id, r.new_id) for r in K.assignments(image(spark, text), 0.2).collect()}
        rows = K.track(image(spark, text).withColumn("position", F.lit(0)), threshold=0.2).where("frame_i = 1").collect()
        out = {(r.y, r.x): r.label for r in rows}
        for old, new in step:
            if sum(n == new for _, n in step) == 1 and sum(o == old for o, _ in step) == 1:
                assert {out[y, x] for y, x in zip(*np.nonzero(frames[1] == old))} == {new}


def test_streamed_tracking_is_the_batch_fold(spark, tmp_path):
    from cellweave.streaming.tracking import OUT, track_stream

    frames = [["1100", "1100"], ["0220", "0220"], ["0033", "0033"]]
    df = image(spark, frames).withColumn("position", F.lit(0).cast("long"))
    for t in range(3):
        df.where(F.col("frame_i") == t).select("position", "frame_i", "y", "x", "label").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(OUT).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    q = track_stream(source).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert back(spark.table("tracked"), (3, 2, 4)) == tracked(spark, frames)


def test_shapes(spark):
    m = image(spark, [["1110", "1010", "1110", "0002"]])
    h = {r.label: r for r in N.hulls(m).collect()}
    assert (h[1].convex_area, h[1].n_holes, h[1].euler_number, h[1].filled_area) == (9.0, 1, 0, 9)
    assert math.isclose(h[1].feret_diameter_max, math.sqrt(18)) and h[2].solidity == 1.0
    s = {r.label: r for r in O.shapes(m).collect()}
    assert (s[1].perimeter, s[1].area, s[1]["bbox-2"]) == (16.0, 8, 3) and math.isnan(s[2].eccentricity)
    assert {r.label for r in N.keep_shapes(m, min_area=2).select("label").distinct().collect()} == {1}


def test_filters():
    p = np.zeros((7, 7), np.float32)
    p[3, 3] = 9
    assert N.opening(p, N.square(1)).max() == 0 and N.speckles(p, 1).max() == 9
    g = N.gaussian(p, 1.0, 1.0)
    assert abs(float(g.sum()) - 9) < 0.2 and g[3, 3] == g.max() and np.allclose(g, g.T)
    assert N.spots(p, 1.0, 1.0).max() == 9 and N.ridges(p, [1.0])[3, 3] > 0 and N.even_light(p, 1, 2.0, False).max() == 9
    assert (N.gaussian(np.ones((4, 5)), 2.0, 0.0) > 0.999).all()
    with pytest.raises(ValueError):
        N.spots(p, 0, 1)


def test_measure_defaults(spark):
    mask = image(spark, [["1100", "1100", "0022", "0022"], ["1100", "1100", "0000", "0000"]])
    channel = lambda a, b: mask.withColumn("value", F.when(F.col("frame_i") == 0, float(a)).otherwise(float(b)))
    out = O.measure({"phase": channel(10, 20), "gfp": channel(30, 40)}, 2, 15.0, 0.25, 0.5)
    got = {(r.frame_i, r.Cell_ID): r for r in out.collect()}
    first = got[(0, 1)]
    assert (first.cell_cycle_stage, first.generation_num, first.relative_ID, first.relationship, first.is_history_known, first.corrected_on_frame_i) == ("G1", 2, -1, "mother", False, -1)
    assert (first.gfp_mean, first.cell_area_um2, got[(0, 2)].disappears_before_end, got[(1, 1)].velocity_pixel, got[(1, 1)].time_seconds) == (30.0, 0.5, 1, 0.0, 15.0)
    assert math.isnan(first.velocity_um) and first.gfp_amount_autoBkgr == 0.0
    assert not O.allowed("mean", "gfp", "_maxProj", save=["mean"], skip=["GFP_mean_maxProj"]) and O.allowed("mean", "gfp", save=[" Mean"])


def test_lineage(spark):
    rows = [(f, c, 0, f * 10 + c) for f in (0, 1) for c in (1, 2, 3)]
    roots = L.roots(spark.createDataFrame(rows, "frame_i long, Cell_ID long, position long, _row_id long"))
    got = {(r.frame_i, r.Cell_ID): r for r in L.update_frame(roots, 0, {2: 1, 3: 1}).collect()}
    assert (got[(0, 2)].parent_ID_tree, got[(0, 2)].generation_num_tree, got[(0, 2)].root_ID_tree, got[(0, 2)].sisters, got[(0, 3)].sisters) == (1, 2, 1, [3], [2])
    forest = [(0, 1, 10, 1, -1, 1, False, []), (1, 1, 1, 1, -1, 1, False, []), (1, 2, 2, 2, 1, 1, True, [])]
    shape = "frame_i long, Cell_ID long, Cell_ID_tree long, generation_num_tree long, parent_ID_tree long, root_ID_tree long, is_history_known boolean, sisters array<long>, position long, _row_id long, signal long"
    df = spark.createDataFrame([(*r, 0, i, 5) for i, r in enumerate(forest)], shape)
    got = {(r.frame_i, r.Cell_ID): r for r in L.propagate(df, 0, [1]).collect()}
    assert got[(1, 1)].Cell_ID_tree == 10 and (got[(1, 2)].parent_ID_tree, got[(1, 2)].generation_num_tree, got[(1, 2)].root_ID_tree, got[(1, 2)].signal) == (10, 2, 1, 5)
    info = [(0, 1, -1), (0, 2, -1), (1, 2, -1), (1, 3, 1), (1, 4, -1)]
    df = spark.createDataFrame([(*r, 0) for r in info], "frame_i long, Cell_ID long, parent_ID_tree long, position long")
    assert sorted((r.kind, r.Cell_ID, r.parent_ID) for r in L.frame_changes(df, frame=1).collect()) == [("orphan", 4, -1), ("with parent", 3, 1)]
    with pytest.raises(Exception):
        L.update_frame(roots, 0, {9: 1}).collect()
    cycle = [(0, 1, -1, "mother", 1, 0), (0, 2, 1, "bud", 0, 1), (0, 3, 1, "bud", 0, 2), (0, 4, 2, "bud", 0, 3), (0, 5, 77, "", None, 4)]
    df = spark.createDataFrame([(*r, 0) for r in cycle], "frame_i long, Cell_ID long, relative_ID long, relationship string, generation_num long, _row_id long, position long")
    got = {r.Cell_ID: (r.parent_ID_tree, r.generation_num_tree, r.root_ID_tree, r.sisters) for r in L.build(df).collect()}
    assert got == {1: (-1, 1, 1, []), 2: (1, 2, 1, [3]), 3: (1, 2, 1, [2]), 4: (2, 3, 1, []), 5: (77, 2, 77, [])}


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("frame_i,Cell_ID,value,flag\n0,1\n1,2,alpha,TRUE,ignored\n 2 ,3,,false\n")
    t = T.read_table(spark, str(tmp_path / "t.csv"))
    assert [tuple(r)[:4] for r in t.orderBy("_row_id").collect()] == [(0.0, 1.0, None, None), (1.0, 2.0, "alpha", True), (2.0, 3.0, None, False)]
    T.write_csv(t, str(tmp_path / "out"), one_file=True)
    assert next((tmp_path / "out").glob("*.csv")).read_text() == "frame_i,Cell_ID,value,flag\n0,1,,\n1,2,alpha,true\n2,3,,false\n"
    with pytest.raises(Exception):
        T.write_csv(t, str(tmp_path / "out"))


def test_sidecars(spark, tmp_path):
    (tmp_path / "metadata.csv").write_text("Description,values\nSizeT,3\nnote,a,b\nSizeT,4\nsegm_isSegm3D,True\nDescription,values\nSizeT,9\n")
    m = C.read_metadata(spark, str(tmp_path / "metadata.csv"))
    assert {r.key: r.value for r in m.collect()} == {"SizeT": "4", "note": "a,b", "segm_isSegm3D": "True"}
    s = C.metadata_summary(m).first()
    assert (s.SizeT, s.TimeIncrement, s.segm_is_3d) == (4, 1.0, {"segm": True})
    (tmp_path / "slices.csv").write_text("Unnamed: 0,Unnamed: 1,z_slice_used_dataPrep,which_z_proj,is_from_dataPrep\nf,0,3,single z-slice,True\nf,0,9,single z-slice,True\nf,1,,x,True\n")
    assert [(r.frame_i, r.z_slice_used_gui) for r in C.read_slices(spark, str(tmp_path / "slices.csv")).collect()] == [(0, 3)]
    (tmp_path / "rois.csv").write_text("roi_id,description,value\n0,x_left,1\n0,x_right,5\n0,y_top,2\n0,y_bottom,4\n0,cropped,1\n1,x_left,1\n")
    roi = C.read_crop_rois(spark, str(tmp_path / "rois.csv"))
    assert [tuple(r)[1:] for r in roi.collect()] == [(0, 2, 1, 4, 5, True)] and C.crop_rois_long(roi).count() == 5
    (tmp_path / "b.json").write_text(json.dumps([{"pos": [1, 2], "size": [3, 4]}, {"state": {"pos": [0, 0], "size": [2, 2]}}]))
    assert sorted(tuple(r)[1:] for r in C.read_background_rois(spark, str(tmp_path / "b.json")).collect()) == [(0, 2, 1, 6, 4), (1, 0, 0, 2, 2)]
    (tmp_path / "t.xml").write_text('<Tracks><particle nSpots="1"><detection t="0" x="1.5" y="2" z="0"/><detection t="1" x="2" y="2" z="0"/></particle><particle><detection t="0" x="9" y="9" z="0"/></particle></Tracks>')
    assert sorted(tuple(r)[:3] for r in C.read_trackmate(spark, str(tmp_path / "t.xml")).collect()) == [(0, 1, 1.5), (0, 2, 9.0), (1, 1, 2.0)]
    assert C.annotation_definitions('{"a": {"type": "single time-point", "symbol": "\'x\'"}}')["a"]["kind"] == "single"
    assert C.metadata_lines({"b": 1, "SizeZ": 2, "SizeT": 3}) == [("SizeT", "3"), ("SizeZ", "2"), ("b", "1")]


def test_arrays(spark, tmp_path):
    a = np.arange(24, dtype=np.uint16).reshape(2, 3, 4)
    np.save(tmp_path / "a.npy", a)
    np.savez_compressed(tmp_path / "b.npz", first=a, second=a[0])
    (tmp_path / "c.tif").write_bytes(R.tiff_bytes(a))
    for name in ("a.npy", "c.tif"):
        px = R.pixels_of(R.read_planes(spark, str(tmp_path / name)))
        assert {(r.frame_i, r.y, r.x): r.value for r in px.collect()} == {(t, y, x): float(a[t, y, x]) for t, y, x in np.ndindex(a.shape)}
    assert sorted((r.name, r.shape, r.dtype) for r in R.probe(spark, str(tmp_path / "b.npz")).collect()) == [("first", [2, 3, 4], "uint16"), ("second", [3, 4], "uint16")]
    assert R.as_volume(a, 1, 2).shape == (1, 2, 3, 4) and R.as_volume(a).shape == (2, 1, 3, 4)
    labels = R.labels_of(R.read_planes(spark, str(tmp_path / "a.npy"))).withColumn("position", F.lit(1))
    for fmt in ("npz", "npy", "tif"):
        (row,) = R.encode_labels(labels, (2, 3, 4), ["position"], fmt).collect()
        assert (R.decode(f"x.{fmt}", bytes(row.content))["arr_0"] == a).all()
    out = R.save_files(R.encode_labels(labels, (2, 3, 4), ["position"]).withColumn("name", F.lit("m.npz")), "name", str(tmp_path / "o"))
    assert out.count() == 1 and (np.load(io.BytesIO((tmp_path / "o/m.npz").read_bytes()))["arr_0"] == a).all()
    with pytest.raises(ValueError):
        R.decode("x.h5", b"")


def test_layout(spark, tmp_path):
    for p in (1, 2, 10):
        d = tmp_path / f"Position_{p}/Images"
        d.mkdir(parents=True)
        for n in ("exp_s1_gfp.tif", "exp_s1_gfp_aligned.npz", "exp_s1_phase.tif", "exp_s1_segm.npz", "exp_s1_metadata.csv", ".hidden.tif"):
            (d / n).write_bytes(b"x")
    files = Y.listing(spark, str(tmp_path))
    got = Y.positions(files).collect()
    assert [r.position for r in got] == ["Position_1", "Position_2", "Position_10"]
    assert got[0].basename == "exp_s1_" and got[0].channels == ["gfp", "phase"] and got[0].images["gfp"].endswith("_aligned.npz") and got[0].metadata.endswith("metadata.csv") and got[0].rois is None
    assert Y.by_end(files, "segm").count() == 3
    assert {r.kind for r in Y.import_sources(spark, str(tmp_path)).collect()} == {"tiff", "npz"}
    flat = spark.createDataFrame([("/a/b10_gfp.tif",), ("/a/b2_gfp.tif",), ("/a/b2_ph.tif",)], "path string")
    assert sorted((r.position, r.channel, r.path) for r in Y.import_plan(flat, "file per channel").collect()) == [("Position_1", "gfp", "/a/b2_gfp.tif"), ("Position_1", "ph", "/a/b2_ph.tif"), ("Position_2", "gfp", "/a/b10_gfp.tif")]


def test_rendering_and_segmentation(spark):
    m = image(spark, [["110", "110", "002"]]).withColumn("value", F.col("label") * 10.0)
    (row,) = D.render(m, bar=2).collect()
    assert bytes(row.content).startswith(b"\x89PNG") and (row.height, row.width) == (3, 3)
    found = S.run_position(m, S.threshold_segmenter(5.0))
    assert back(found, (1, 3, 3)) == [["110", "110", "002"]]
    assert back(S.run_position(m, S.threshold_segmenter(5.0), min_area=2, roi=X.inside(0, 0, 3, 3)), (1, 3, 3)) == [["110", "110", "000"]]


def test_workflow(spark):
    text = "[workflow]\ntype = measurements\ndo_tracking = yes\n[paths_info]\npaths = /a, /b\nstop_frame_numbers = 2\n[measurements]\nchannels = gfp\nmetrics_to_skip = q05\n[segmentation_model_params]\npreprocess_step_1 = gaussian_filter: sigma_y=1; sigma_x=2\n[tracker_params]\nioa_threshold = 0.5\n"
    w = W.parse(text)
    assert w.paths == ["/a", "/b"] and w.stop_frames == [2, 2] and w.track and w.threshold == 0.5 and w.steps == [("gaussian_filter", {"sigma_y": 1.0, "sigma_x": 2.0})]
    m = image(spark, [["1100"], ["0220"], ["0000"]]).withColumn("value", F.lit(3.0))
    got = W.run_measurements(w, {"gfp": m}, 3).collect()
    assert sorted((r.frame_i, r.Cell_ID) for r in got) == [(0, 1), (1, 1)]
    for wrong in ("[nonsense]\na = 1\n", "[workflow]\ntype = other\n", "[workflow]\ntype = measurements\n", text.replace("= 2\n[m", "= 2, 3, 4\n[m"), text.replace("yes", "perhaps")):
        with pytest.raises(W.WorkflowError):
            W.parse(wrong)
    with pytest.raises(W.WorkflowError):
        W.run_measurements(w, {"phase": m}, 3)
