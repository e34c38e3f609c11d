"""Arrays read by their planes' places in files, typed sinks, conversion, and files written by tasks."""

import io

import numpy as np
import pytest

from cellweave.sources import arrays as R
from cellweave.sources import named


class Counted(io.BytesIO):
    """A file that counts what is read of it."""

    n = 0

    def read(self, *size):
        out = super().read(*size)
        Counted.n += len(out)
        return out


def test_headers_alone_are_read():
    big = np.zeros((40, 256, 256), np.float32)
    for name, fill in (("a.npy", lambda f: np.save(f, big)), ("a.npz", lambda f: np.savez(f, x=big, y=big[:3])), ("a.tif", lambda f: f.write(R.tiff_bytes(big)))):
        f = io.BytesIO()
        fill(f)
        Counted.n = 0
        found = R.entries(name, Counted(f.getvalue()))
        assert found[0].shape == big.shape and len(found[0].planes) == 40 and Counted.n < 40_000 < len(f.getvalue()) // 100
        at, size = found[0].planes[7][0]
        assert size == 256 * 256 * 4 and f.getvalue()[at : at + size] == big[7].tobytes()


def read(spark, path, **sizes):
    rows = R.read_planes(spark, path, **sizes).collect()
    return {(r.name, r.frame_i, r.z): np.array(r.data, np.float32).reshape(r.height, r.width) for r in rows}, {r.dtype for r in rows}


@pytest.mark.parametrize("kind", ["npy", "npz", "packed", "tif", "fortran"])
def test_planes_of_every_kind_of_file(spark, tmp_path, kind):
    a = np.random.default_rng(1).integers(0, 60000, (6, 5, 7)).astype(np.uint16)
    path = str(tmp_path / f"x.{'npz' if kind in ('npz', 'packed') else 'tif' if kind == 'tif' else 'npy'}")
    if kind == "tif":
        (tmp_path / "x.tif").write_bytes(R.tiff_bytes(a))
    elif kind in ("npz", "packed"):
        (np.savez if kind == "npz" else np.savez_compressed)(path, one=a, two=a[:2])
    else:
        np.save(path, np.asfortranarray(a) if kind == "fortran" else a)
    name = "one" if kind in ("npz", "packed") else "arr_0"
    got, dtypes = read(spark, path, range_bytes=100)
    assert dtypes == {"uint16"} and all((got[name, t, 0] == a[t]).all() for t in range(6)) and len(got) == (8 if name == "one" else 6)
    if name == "arr_0":
        got, _ = read(spark, path, size_t=2, size_z=3)
        assert all((got[name, t, z] == a[3 * t + z]).all() for t in range(2) for z in range(3))
    ranges = R.plane_ranges(spark, path, 100).where(f"name = '{name}'").count()
    assert ranges == (1 if kind in ("packed", "fortran") else 6)
    assert {(r.name, tuple(r.shape), r.dtype) for r in R.probe(spark, path).collect()} == {(name, (6, 5, 7), "uint16")} | ({("two", (2, 5, 7), "uint16")} if name == "one" else set())


def test_other_endings_are_read_whole(spark, tmp_path, monkeypatch):
    (tmp_path / "x.raw").write_bytes(bytes(range(6)))
    with pytest.raises(Exception, match="no decoder"):
        R.read_planes(spark, str(tmp_path / "x.raw")).collect()


def test_types_of_planes():
    plane = np.array([[0.0, 0.5], [1.0, 0.25]])
    assert R.to_type(plane, "uint8").tolist() == [[0, 128], [255, 64]] and R.to_type(plane, "float32").dtype == np.float32
    assert R.to_type(np.array([[-5.0, 5.0], [0.0, 2.5]]), "uint16").tolist() == [[0, 65535], [32768, 49151]]
    assert R.to_type(np.array([[300.0, 300.0]]), "uint8").tolist() == [[0, 0]] and R.to_type(np.array([[2.5, 7.4]]), "uint8").tolist() == [[3, 7]]


def test_conversion_keeps_types(spark, tmp_path):
    a = np.random.default_rng(2).integers(-3, 9, (2, 3, 4)).astype(np.int16)
    np.savez_compressed(tmp_path / "x.npz", a)
    (row,) = R.convert(R.read_planes(spark, str(tmp_path / "x.npz")), "npy").collect()
    back = np.load(io.BytesIO(bytes(row.content)))
    assert back.dtype == np.int16 and (back == a).all()
    (row,) = R.convert(R.read_planes(spark, str(tmp_path / "x.npz")), "tif", cast_labels=True).collect()
    assert (R.tiff_pages(bytes(row.content)) == np.maximum(a, 0)).all()


def test_files_have_their_names_once_all_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i % 3}/f{i}.bin", bytes([i] * i)) for i in range(20)], "path string, content binary").repartition(4)
    assert named.save_files(rows, "path", str(tmp_path)).count() == 20
    found = {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}
    assert found == {f"p{i % 3}/f{i}.bin": bytes([i] * i) for i in range(20)}
    with pytest.raises(Exception, match="same name"):
        named.save_files(rows.unionByName(rows.limit(1)).withColumnRenamed("path", "n"), "n", str(tmp_path / "again"))
    assert not [p for p in (tmp_path / "again").rglob("*") if p.is_file()]


def test_lines_in_order(spark, tmp_path):
    lines = spark.createDataFrame([("a/x.csv", 2, "c"), ("a/x.csv", 0, "a,é"), ("a/x.csv", 1, ""), ("b.json", 0, "{}")], "path string, n long, line string")
    named.save_lines(lines, str(tmp_path))
    assert (tmp_path / "a/x.csv").read_text() == "a,é\n\nc\n" and (tmp_path / "b.json").read_text() == "{}\n"


@pytest.mark.parametrize(("path", "by_tasks"), [("/a/b", True), ("file:///a", True), ("s3a://b/c", True), ("viewfs://s/a", False), ("hdfs://n/a", False)])
def test_what_tasks_can_open(path, by_tasks):
    assert named.opened_by_tasks(path) == by_tasks


def test_an_import_carried_out(spark, tmp_path):
    from cellweave.sources import imports, layout, sidecars

    rng = np.random.default_rng(5)
    stacks = {(p, c): rng.integers(0, 4000, (4, 5, 6)).astype(np.uint16) for p in ("exp2", "exp10") for c in ("gfp", "bf")}
    (tmp_path / "raw").mkdir()
    for (p, c), a in stacks.items():
        (tmp_path / f"raw/{p}_{c}.tif").write_bytes(R.tiff_bytes(a))
    plan = layout.import_plan(layout.import_sources(spark, str(tmp_path / "raw")), "file per channel")
    out = str(tmp_path / "out")
    done = imports.carry_out(spark, plan, out, "demo_", frames=(1, 3), metadata={"TimeIncrement": 15.0})
    assert sorted(r.name for r in done.collect()) == [f"Position_{i}/Images/demo_{c}.tif" for i in (1, 2) for c in ("bf", "gfp")]
    for i, p in ((1, "exp2"), (2, "exp10")):
        for c in ("gfp", "bf"):
            back = R.tiff_pages((tmp_path / f"out/Position_{i}/Images/demo_{c}.tif").read_bytes())
            assert back.dtype == np.uint16 and (back == stacks[p, c][1:3]).all()
    known = sidecars.metadata_summary(sidecars.read_metadata(spark, f"{out}/*/Images/demo_metadata.csv")).collect()
    assert [(r.basename, r.SizeT, r.SizeZ, r.TimeIncrement) for r in known] == [("demo_", 2, 1, 15.0)] * 2
    found = layout.positions(layout.listing(spark, out)).collect()
    assert [(r.position, r.channels, r.metadata is not None) for r in found] == [("Position_1", ["bf", "gfp"], True), ("Position_2", ["bf", "gfp"], True)]


def test_frames_in_files_of_their_own(spark, tmp_path):
    from cellweave.sources import imports, layout

    for t in (9, 10, 2):
        (tmp_path / f"a_gfp_{t}.tif").write_bytes(R.tiff_bytes(np.full((1, 3, 4), t, np.uint8)))
    plan = layout.import_plan(layout.import_sources(spark, str(tmp_path)), "file per frame")
    (row,) = imports.channel_files(spark, plan).collect()
    assert row.name == "Position_1/Images/s01_gfp.tif" and R.tiff_pages(bytes(row.content))[:, 0, 0].tolist() == [2, 9, 10]


def test_free_hand_regions(spark, tmp_path):
    (tmp_path / "a").mkdir()
    np.savez(tmp_path / "a/x.npz", **{"3_10_5_11": np.array([[1, 0, 1], [0, 1, 0]], bool)})
    got = R.freehand_pixels(R.read_planes(spark, str(tmp_path / "a/x.npz"))).select("y", "x").collect()
    assert sorted(map(tuple, got)) == [(10, 3), (10, 5), (11, 4)]
    (row,) = R.encode_freehand(spark.createDataFrame([("p", 10, 3), ("p", 10, 5), ("p", 11, 4)], "position string, y long, x long"), ["position"]).collect()
    with np.load(io.BytesIO(bytes(row.content))) as z:
        assert z.files == ["3_10_5_11"] and z["3_10_5_11"].tolist() == [[True, False, True], [False, True, False]]
    np.savez(tmp_path / "b.npz", wrong=np.ones((2, 2), bool))
    with pytest.raises(Exception, match="not the box of a region"):
        R.freehand_pixels(R.read_planes(spark, str(tmp_path / "b.npz"))).collect()


def test_pixels_keep_their_planes_type_without_meeting_the_planes_again(spark):
    """As many pixels as a table has were broadcast to meet the types of their planes."""
    from cellweave.plans.files import typed_image_round_trip

    out = typed_image_round_trip(spark, "/root/testdata/sf0.001")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString() and {r.dtype for r in out.collect()} == {"uint8"}
