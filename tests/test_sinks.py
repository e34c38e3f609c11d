"""Small files written beside the images, read back by the library's own readers; and measuring with depth, hulls and positions."""

import glob
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import combine, objects
from cellweave.plans import workflow
from cellweave.sources import sidecars, sinks


def lines_of(df):
    out = {}
    for x in df.orderBy("path", "n").collect():
        out.setdefault(x.path, []).append(x.line)
    return out


def test_slices_written_and_read(spark, tmp_path):
    columns = "path string, filename string, frame_i long, z_slice_used_dataPrep long, which_z_proj string, is_from_dataPrep boolean, z_slice_used_gui long, which_z_proj_gui string"
    rows = [("P1", "b,c", 2, 4, "single z-slice", True, 4, "single z-slice"), ("P1", "a", 0, 3, "max", False, 5, "mean"), ("P2", "a", 0, 1, "max", True, None, None)]
    sinks.write_lines(sinks.slice_lines(spark.createDataFrame(rows, columns)), str(tmp_path / "s"))
    got = sorted(tuple(r) for r in sidecars.read_slices(spark, glob.glob(f"{tmp_path}/s/path=P1/*.txt")).drop("_row_id").collect())
    assert got == [("a", 0, 3, "max", 5, "mean", False), ("b,c", 2, 4, "single z-slice", 4, "single z-slice", True)]
    assert len(glob.glob(f"{tmp_path}/s/path=*/*.txt")) == 2
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_lines(sinks.slice_lines(spark.createDataFrame(rows, columns)), str(tmp_path / "s"))


def test_metadata_regions_and_mappers(spark, tmp_path):
    rows = spark.createDataFrame([("P", "zeta", "q"), ("P", "SizeT", "7"), ("P", "basename", 'x"y'), ("Q", "SizeZ", "1")], "path string, key string, value string")
    assert lines_of(sinks.metadata_rows(rows)) == {"P": ["Description,values", 'basename,"x""y"', "SizeT,7", "zeta,q"], "Q": ["Description,values", "SizeZ,1"]}
    rois = spark.createDataFrame([("P", 1, 2, 3, 9, 8), ("P", 0, 0, 0, 4, 6)], "path string, n long, top long, left long, bottom long, right long")
    sinks.write_lines(sinks.background_roi_json(rois), str(tmp_path / "r"))
    back = sidecars.read_background_rois(spark, glob.glob(f"{tmp_path}/r/path=P/*.txt")).orderBy("n").drop("path").collect()
    assert [tuple(r) for r in back] == [(0, 0, 0, 4, 6), (1, 2, 3, 9, 8)]
    ids = "path string, frame_i long, old long, new long"
    first, second = spark.createDataFrame([("P", 10, 3, 40), ("Q", 1, 2, 9)], ids), spark.createDataFrame([("P", 2, 5, 6), ("P", 10, 7, 3), ("P", 10, 1, 2)], ids)
    got = {p: json.loads(x[0]) for p, x in lines_of(sinks.replaced_ids_json(first, second)).items()}
    assert got == {"P": {"2": {"second_pass": {"5": 6}}, "10": {"first_pass": {"3": 40}, "second_pass": {"7": 3, "1": 2}}}, "Q": {"1": {"first_pass": {"2": 9}}}}
    gone = spark.createDataFrame([("P", 2, 8), ("P", 2, 4), ("P", 0, 1)], "path string, frame_i long, old long")
    assert json.loads(lines_of(sinks.deleted_ids_json(gone))["P"][0]) == {"0": [1], "2": [4, 8]}
    assert sinks.mapper_names("exp_segm.npz") == ("exp_segm_deletedIDs_mapper.json", "exp_segm_replacedIDs_mapper.json")


def test_definitions_and_equations():
    own = {"mitotic": {"kind": "multiple", "symbol": "x", "colour": [1, 2, 3], "shortcut": "m", "description": "é", "keep_active": False, "hide": True}}
    assert sidecars.annotation_definitions(sinks.definitions_json(own)) == own
    assert sinks.equations_ini(["b.csv", "a.csv"], {"z": "a + b", "c": "a"}).split("\n") == ["[sources]", "table1 = b.csv", "table2 = a.csv", "", "[equations]", "c = a", "z = a + b"]


def test_digits_of_any_length_sort_by_value(spark):
    names = ["p2", "p10", "p0010b", "p" + "9" * 30, "p1" + "0" * 30, "p1" + "0" * 29 + "1"]
    got = [r.name for r in spark.createDataFrame([(n,) for n in names[::-1]], "name string").orderBy(combine.natural_key("name")).collect()]
    assert got == ["p2", "p10", "p0010b", "p" + "9" * 30, "p1" + "0" * 30, "p1" + "0" * 29 + "1"]


def volume(spark):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 50, (2, 3, 6, 7))
    labels = np.zeros((2, 6, 7), int)
    labels[:, 1:4, 1:5] = 1
    labels[0, 2, 2] = 0
    pixels = [(f, z, y, x, float(values[f, z, y, x])) for f, z, y, x in np.ndindex(values.shape)]
    where = [(f, y, x, int(labels[f, y, x])) for f, y, x in np.ndindex(labels.shape)]
    return values, labels, spark.createDataFrame(pixels, "frame_i int, z int, y int, x int, value double"), spark.createDataFrame(where, "frame_i int, y int, x int, label int")


def test_variants_and_hulls_in_the_object_table(spark):
    values, labels, pixels, where = volume(spark)
    chosen = spark.createDataFrame([(0, 2), (1, 0)], "frame_i int, z int")
    given = objects.variants(pixels, where, chosen, every_slice=[1])
    table = {r.frame_i: r for r in objects.measure({"gfp": given}, 2, with_hulls=True).collect()}
    for f in (0, 1):
        inside = labels[f] == 1
        planes = {"_maxProj": values[f].max(0), "_meanProj": values[f].mean(0), "_zSlice": values[f][(2, 0)[f]], "_zSlice1": values[f][1]}
        for name, plane in planes.items():
            assert np.isclose(table[f][f"gfp_mean{name}"], plane[inside].mean())
    assert [table[f].n_holes for f in (0, 1)] == [1, 0] and table[1].solidity == pytest.approx(1.0) and table[0].euler_number == 0
    kept = objects.measure({"gfp": given}, 2, save=["mean_zSlice"]).columns
    assert [c for c in kept if c.startswith("gfp_")] == ["gfp_mean_zSlice"]


def test_workflow_measures_each_position_up_to_its_stop_frame(spark):
    _, _, pixels, where = volume(spark)
    plane = pixels.where("z = 0").drop("z").join(where, ["frame_i", "y", "x"])
    both = plane.withColumn("position", F.lit("a")).unionByName(plane.withColumn("position", F.lit("b")))
    text = "[workflow]\ntype = measurements\ndo_tracking = {}\n[paths_info]\npaths = a\n  b\nstop_frame_numbers = -1, 1\n[measurements]\nchannels = gfp\n"
    for tracked in ("no", "yes"):
        flow = workflow.parse(text.format(tracked))
        got = workflow.run_measurements(flow, {"gfp": both}, 2).select("position", "frame_i", "Cell_ID", "area").collect()
        assert sorted(map(tuple, got)) == [("a", 0, 1, 11.0), ("a", 1, 1, 12.0), ("b", 0, 1, 11.0)]


def test_lineage_info_and_cycle_fields(spark):
    from cellweave.operators import annotations

    changes = spark.createDataFrame([("P", 1, "with parent", 9, 2), ("P", 1, "with parent", 4, 2), ("P", 1, "lost", 7, -1), ("P", 1, "orphan", 5, -1), ("Q", 1, "lost", 3, -1)], "path string, frame_i long, kind string, Cell_ID long, parent_ID long")
    got = {p: json.loads(x[0]) for p, x in lines_of(sinks.lineage_info_json(changes)).items()}
    assert got["P"] == {"cells_with_parent": [{"cell_id": 4, "parent_id": 2}, {"cell_id": 9, "parent_id": 2}], "orphan_cells": [5], "lost_cells": [7]}
    assert got["Q"] == {"cells_with_parent": [], "orphan_cells": [], "lost_cells": [3]}
    rows = [("a", 0, 1, "S", 2, 5, "bud", "TRUE", 0), ("a", 0, 1, "G1", 9, 9, "x", "1", 1), ("a", 1, 1, None, None, None, None, "yes", 2), ("b", 0, 1, "S", 1, 1, "bud", "1", 3)]
    df = spark.createDataFrame(rows, "position string, frame_i long, Cell_ID long, cell_cycle_stage string, generation_num long, relative_ID long, relationship string, is_history_known string, _row_id long")
    asked = spark.createDataFrame([("a", 0, 1), ("a", 1, 1), ("a", 2, 1)], "position string, frame_i long, Cell_ID long")
    assert sorted(map(tuple, annotations.cycle_fields(df, asked).collect())) == [("a", 0, 1, "S", 2, 5, "bud", True), ("a", 1, 1, "", -1, -1, "", False)]
