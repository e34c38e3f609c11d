"""Queries of readers and writers, of pictures, segmentation and workflows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import areas
from cellweave.operators import combine as C
from cellweave.operators import pixels as X
from cellweave.operators import render as D
from cellweave.operators import segment as S
from cellweave.plans import workflow as W
from cellweave.plans.adapters import oracle, table
from cellweave.session import scratch
from cellweave.sources import arrays as R
from cellweave.sources import sidecars as I
from cellweave.sources import sinks as K
from cellweave.sources import tables as T
from cellweave.sources.named import save_lines

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None, *views: str):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = (f, sql and oracle(sql, *(views or ("mask",))))
        return f

    return add


@query("""SELECT CAST(position AS DOUBLE) AS position, CAST(frame_i AS DOUBLE) AS frame_i, CAST(Cell_ID AS DOUBLE) AS Cell_ID, relationship, cell_vol_fl, will_divide <> 0 AS divides,
  CASE WHEN Cell_ID % 5 = 0 THEN NULL ELSE 'note ' || Cell_ID || ', "quoted"' END AS note FROM objects""", "objects")
def csv_round_trip(spark, d):
    o = table(spark, d, "objects")
    note = F.when(F.col("Cell_ID") % 5 != 0, F.concat(F.lit("note "), F.col("Cell_ID").cast("string"), F.lit(', "quoted"')))
    rows = o.select("position", "frame_i", "Cell_ID", "relationship", "cell_vol_fl", (F.col("will_divide") != 0).alias("divides"), note.alias("note"))
    folder = f"{scratch(spark)}/table.csv"
    T.write_csv(rows, folder)
    return T.read_csv(spark, folder).drop("_row_id")


def _named(rows: DataFrame, leaf: str) -> DataFrame:
    return rows.withColumn("name", F.concat("position", F.lit(f"/Images/{leaf}")))


def _position(df: DataFrame) -> DataFrame:
    return df.withColumn("position", F.regexp_extract("path", "/(Position_[0-9]+)/Images/", 1))


@query("SELECT position, frame_i, y, x, label FROM scenes WHERE label <> 0", "scenes")
def label_file_round_trip(spark, d):
    folder = scratch(spark)
    R.save_files(_named(R.encode_labels(table(spark, d, "scenes").where("label <> 0"), (7, 48, 48), ["position"], "npz"), "exp_segm.npz"), "name", folder)
    return _position(R.labels_of(R.read_planes(spark, f"{folder}/*/Images/exp_segm.npz", size_t=7))).select("position", "frame_i", "y", "x", "label")


@query("SELECT position, frame_i, z, y, x, label FROM stacks WHERE label <> 0", "stacks")
def volume_file_round_trip(spark, d):
    folder = scratch(spark)
    R.save_files(_named(R.encode_labels(table(spark, d, "stacks").where("label <> 0"), (2, 7, 24, 24), ["position"], "tif"), "exp_segm.tif"), "name", folder)
    planes = R.read_planes(spark, f"{folder}/*/Images/exp_segm.tif", size_t=2, size_z=7, range_bytes=1 << 14)
    return _position(R.labels_of(planes)).select("position", "frame_i", "z", "y", "x", "label")


@query("SELECT DISTINCT position, 'arr_0' AS name, '7,48,48' AS shape, 'uint32' AS dtype FROM scenes WHERE label <> 0", "scenes")
def array_probe(spark, d):
    folder = scratch(spark)
    R.save_files(_named(R.encode_labels(table(spark, d, "scenes").where("label <> 0"), (7, 48, 48), ["position"], "npy"), "exp_segm.npy"), "name", folder)
    found = _position(R.probe(spark, f"{folder}/*/Images/exp_segm.npy"))
    return found.select("position", "name", F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"), "dtype")


@query(""", e AS (SELECT position, frame_i, CASE WHEN count(*) = 2304 THEN min(value) ELSE 0 END AS low, max(value) AS high FROM scenes GROUP BY 1, 2),
  v AS (SELECT position, frame_i, y, x, CASE WHEN high <= 1 THEN value * 255 WHEN high > 255 THEN (value - low) / (high - low) * 255 ELSE value END AS v FROM scenes JOIN e USING (position, frame_i))
  SELECT position, frame_i, y, x, CAST(least(greatest(floor(v + 0.5), 0), 255) AS BIGINT) AS value, 'uint8' AS dtype FROM v WHERE floor(v + 0.5) > 0""", "scenes")
def typed_image_round_trip(spark, d):
    folder = scratch(spark)
    R.save_files(_named(R.encode_images(table(spark, d, "scenes"), (7, 48, 48), ["position"], dtype="uint8"), "exp_gfp.tif"), "name", folder)
    planes = R.read_planes(spark, f"{folder}/*/Images/exp_gfp.tif", size_t=7, range_bytes=1 << 12)
    out = R.pixels_of(planes, keep=["dtype"]).where("value <> 0")
    return _position(out).select("position", "frame_i", "y", "x", F.col("value").cast("long").alias("value"), "dtype")


@query("""SELECT s.position, 'roi' || r.roi_id || '_data' AS name, frame_i, y - greatest(r.top, 0) AS y, x - greatest(r."left", 0) AS x, value
  FROM scenes s JOIN rois r ON r.position = s.position AND y >= r.top AND y < r.bottom AND x >= r."left" AND x < r."right" """, "scenes", "rois")
def archive_file_round_trip(spark, d):
    folder = scratch(spark)
    archives = areas.archives(table(spark, d, "scenes").select("position", "frame_i", "y", "x", "value"), table(spark, d, "rois"))
    R.save_files(_named(R.encode_archives(archives, ["position"]), "exp_gfp_bkgrRoiData.npz"), "name", folder)
    pixels = R.pixels_of(R.read_planes(spark, f"{folder}/*/Images/exp_gfp_bkgrRoiData.npz")).where("value <> 0")
    return _position(pixels).select("position", "name", "frame_i", "y", "x", F.col("value").cast("double").alias("value"))


@query("SELECT DISTINCT position, frame_i, y, x, CAST(label AS BIGINT) AS label FROM scenes WHERE label <> 0", "scenes")
def converted_files(spark, d):
    folder = scratch(spark)
    R.save_files(_named(R.encode_labels(table(spark, d, "scenes").where("label <> 0"), (7, 48, 48), ["position"], "npz"), "exp_segm.npz"), "name", folder)
    turned = R.convert(R.read_planes(spark, f"{folder}/*/Images/exp_segm.npz", size_t=7), "npy", cast_labels=True)
    R.save_files(_named(_position(turned), "exp_segm.npy"), "name", folder)
    return _position(R.labels_of(R.read_planes(spark, f"{folder}/*/Images/exp_segm.npy", size_t=7))).select("position", "frame_i", "y", "x", "label")


@query("SELECT DISTINCT position, y, x FROM scenes WHERE (y * x) % 7 < 3 AND y >= 5 AND x >= 9", "scenes")
def freehand_file_round_trip(spark, d):
    folder = scratch(spark)
    region = table(spark, d, "scenes").where("(y * x) % 7 < 3 and y >= 5 and x >= 9").select("position", "y", "x").distinct()
    R.save_files(_named(R.encode_freehand(region, ["position"]), "exp_dataPrepFreeRoi.npz"), "name", folder)
    return _position(R.freehand_pixels(R.read_planes(spark, f"{folder}/*/Images/exp_dataPrepFreeRoi.npz"))).select("position", "y", "x")


@query("""SELECT position, CAST(count(DISTINCT frame_i) AS VARCHAR) AS frames, CAST(max(label) AS VARCHAR) || ',"x"' AS note FROM scenes GROUP BY 1""", "scenes")
def named_sidecars(spark, d):
    folder = scratch(spark)
    known = table(spark, d, "scenes").groupBy("position").agg(F.count_distinct("frame_i").cast("string").alias("SizeT"), F.concat(F.max("label").cast("string"), F.lit(',"x"')).alias("note"))
    rows = known.select(F.concat("position", F.lit("/Images/exp_metadata.csv")).alias("path"), F.explode(F.create_map(F.lit("SizeT"), "SizeT", F.lit("note"), "note")).alias("key", "value"))
    save_lines(K.metadata_rows(rows), folder)
    back = spark.read.csv(f"{folder}/*/Images/exp_metadata.csv", header=True, escape='"').withColumn("path", F.col("_metadata.file_path"))
    one = lambda k: F.max(F.when(F.col("Description") == k, F.col("values")))
    return _position(back).groupBy("position").agg(one("SizeT").alias("frames"), one("note").alias("note"))


@query("""SELECT CAST(r_regionkey AS BIGINT) AS roi_id, CAST(r_regionkey AS BIGINT) AS top, CAST(2 AS BIGINT) AS "left", CAST(r_regionkey + 5 AS BIGINT) AS bottom, CAST(9 AS BIGINT) AS "right", r_regionkey % 2 = 1 AS cropped FROM region""")
def crop_roi_file_round_trip(spark, d):
    regions = spark.read.parquet(f"{d}/region.parquet")
    rois = regions.select(F.col("r_regionkey").alias("roi_id"), F.col("r_regionkey").alias("top"), F.lit(2).alias("left"), (F.col("r_regionkey") + 5).alias("bottom"), F.lit(9).alias("right"), (F.col("r_regionkey") % 2 == 1).alias("cropped"))
    folder = f"{scratch(spark)}/rois.csv"
    I.crop_rois_long(rois).coalesce(1).write.csv(folder, header=True)
    return I.read_crop_rois(spark, folder).drop("path")


@query(""", a AS (SELECT frame_i, Cell_ID, position, min(cell_vol_fl) AS v FROM objects GROUP BY 1, 2, 3), p AS (SELECT * FROM a)
  SELECT 'Position_' || (position + 1) AS Position_n, frame_i, Cell_ID, v / 2 + v AS ratio FROM p""", "objects")
def multi_channel_formula(spark, d):
    o = table(spark, d, "objects")
    base = o.groupBy("frame_i", "Cell_ID", "position").agg(F.min("cell_vol_fl").alias("v"), F.min("_row_id").alias("_row_id"))
    named = base.withColumn("Position_n", F.concat(F.lit("Position_"), (F.col("position") + 1).cast("string"))).drop("position")
    return C.combine_metrics([named, named.withColumnRenamed("v", "w")], {"ratio": "gfp_v / 2 + w_phase"}, ["gfp", "phase"])


@query("SELECT frame_i, CAST(z AS BIGINT) AS z, y, x, value FROM mask, (SELECT unnest(range(3)) AS z)")
def channel_depth_broadcast(spark, d):
    return X.broadcast_depth(table(spark, d, "mask").select("frame_i", "y", "x", "value"), 3)


@query()
def rendered_frames(spark, d):
    return D.render(table(spark, d, "mask"), bar=5).select("frame_i", "height", "width", F.sha2("content", 256).alias("content_sha256"))


@query("""SELECT count(*) > 0 AS found, bool_and(above) AS all_above FROM (SELECT value > 100 AS above FROM mask WHERE value > 100)""")
def segmentation_hook(spark, d):
    m = table(spark, d, "mask")
    found = S.run_position(m, S.threshold_segmenter(100.0), stop_frame=7)
    seen = found.join(m.select("frame_i", "y", "x", "value"), ["frame_i", "y", "x"])
    return seen.agg((F.count("*") > 0).alias("found"), F.bool_and(F.col("value") > 100).alias("all_above"))


WORKFLOW = """
[workflow]
type = measurements
[paths_info]
paths = lineitem
stop_frame_numbers = 4
[measurements]
channels = gfp
metrics_to_skip = q05, gfp_q95
"""


@query("""SELECT frame_i, label AS Cell_ID, count(*) AS cell_area_pxl, sum(value) AS gfp_sum, max(value) AS gfp_max FROM mask WHERE label <> 0 AND frame_i < 4 GROUP BY 1, 2""")
def workflow_measurements(spark, d):
    m = table(spark, d, "mask")
    out = W.run_measurements(W.parse(WORKFLOW), {"gfp": m, "other": m}, 7)
    return out.select("frame_i", "Cell_ID", "cell_area_pxl", "gfp_sum", "gfp_max")
