"""Queries of the operators on label images and channels, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.operators import align as L
from cellweave.operators import objects as O
from cellweave.operators import pixels as X
from cellweave.plans.adapters import oracle, table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None, *views: str):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = (f, sql and oracle(sql, *(views or ("mask",))))
        return f

    return add


def mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mask")


def volume(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "volume")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(f"`{n}`"), 6) for n in names})


@query("SELECT CAST(count(DISTINCT (frame_i, label)) AS BIGINT) AS total_objects, count(DISTINCT label) AS unique_objects FROM mask WHERE label <> 0")
def object_counts(spark, d):
    return X.object_counts(mask(spark, d))


@query("SELECT frame_i, label AS Cell_ID, y, x FROM mask WHERE label <> 0")
def object_coords(spark, d):
    return X.coordinates(mask(spark, d))


@query("SELECT position, label AS Cell_ID, y, x FROM scenes WHERE label <> 0 AND frame_i = 2", "scenes")
def object_coords_plane(spark, d):
    return X.coordinates(table(spark, d, "scenes").where("frame_i = 2"), ["position"])


@query("SELECT position, label AS Cell_ID, z, y, x FROM stacks WHERE label <> 0 AND frame_i = 1", "stacks")
def object_coords_stack(spark, d):
    return X.coordinates(table(spark, d, "stacks").where("frame_i = 1"), ["position"], ["z", "y", "x"])


@query("SELECT position, frame_i, label AS Cell_ID, z, y, x FROM stacks WHERE label <> 0", "stacks")
def object_coords_stacks(spark, d):
    return X.coordinates(table(spark, d, "stacks"), ["position", "frame_i"], ["z", "y", "x"])


@query("SELECT frame_i, label, count(*) AS n_voxels FROM volume WHERE label <> 0 GROUP BY 1, 2", "volume")
def voxel_counts(spark, d):
    return X.voxel_counts(volume(spark, d))


@query("""SELECT frame_i, label, count(*) AS area, round(avg(y), 6) AS "centroid-0", round(avg(x), 6) AS "centroid-1", min(y) AS "bbox-0", min(x) AS "bbox-1", max(y) + 1 AS "bbox-2", max(x) + 1 AS "bbox-3",
  CAST(floor(avg(y)) AS BIGINT) AS y_centroid, CAST(floor(avg(x)) AS BIGINT) AS x_centroid FROM mask WHERE label <> 0 GROUP BY 1, 2""")
def region_props(spark, d):
    return rounded(O.regions(mask(spark, d)), "centroid-0", "centroid-1")


_INERTIA = """m AS (SELECT frame_i, label, count(*) AS area, var_pop(y) AS yy, var_pop(x) AS xx, covar_pop(x, y) AS xy, avg(y) AS cy, avg(x) AS cx FROM mask WHERE label <> 0 GROUP BY 1, 2),
  e AS (SELECT *, greatest((xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy ** 2), 0) AS l0, greatest((xx + yy) / 2 - sqrt(((xx - yy) / 2) ** 2 + xy ** 2), 0) AS l1 FROM m)"""


@query(f""", {_INERTIA}
  SELECT frame_i, label, area, round(4 * sqrt(l0), 6) AS major_axis_length, round(4 * sqrt(l1), 6) AS minor_axis_length, round(atan2(2 * xy, xx - yy) / 2, 6) AS orientation,
    CASE WHEN l0 = 0 THEN 'nan'::DOUBLE ELSE round(sqrt(greatest(1 - l1 / l0, 0)), 6) END AS eccentricity FROM e""")
def inertia_axes(spark, d):
    return rounded(O.inertia(mask(spark, d)), "major_axis_length", "minor_axis_length", "orientation", "eccentricity")


_PERIMETER = """p AS (SELECT m.frame_i, m.label, CAST(4 * count(*) - 2 * (count(r.x) + count(b.x)) AS DOUBLE) AS perimeter FROM mask m
    LEFT JOIN mask r ON r.frame_i = m.frame_i AND r.label = m.label AND r.y = m.y AND r.x = m.x + 1 LEFT JOIN mask b ON b.frame_i = m.frame_i AND b.label = m.label AND b.y = m.y + 1 AND b.x = m.x
    WHERE m.label <> 0 GROUP BY 1, 2)"""


@query(f", {_PERIMETER} SELECT * FROM p")
def perimeter(spark, d):
    return X.perimeters(mask(spark, d))


@query(f""", {_INERTIA}, {_PERIMETER}, b AS (SELECT frame_i, label, (max(y) + 1 - min(y)) * (max(x) + 1 - min(x)) AS box FROM mask WHERE label <> 0 GROUP BY 1, 2)
  SELECT e.frame_i, e.label, round(4 * pi() * area / perimeter ** 2, 6) AS circularity, CASE WHEN l0 = 0 THEN 'nan'::DOUBLE ELSE round(4 * area / (pi() * (4 * sqrt(l0)) ** 2), 6) END AS roundness,
    CASE WHEN l1 < 1e-9 THEN 'nan'::DOUBLE ELSE round(sqrt(l0) / sqrt(l1), 5) END AS aspect_ratio, round(area / box, 6) AS extent, round(sqrt(4 * area / pi()), 6) AS equivalent_diameter
  FROM e JOIN p USING (frame_i, label) JOIN b USING (frame_i, label)""")
def shape_metrics(spark, d):
    out = O.shapes(mask(spark, d))
    flat = F.when(F.col("minor_axis_length") < 1e-4, float("nan")).otherwise(F.round("aspect_ratio", 5)).alias("aspect_ratio")
    return rounded(out, "circularity", "roundness", "extent", "equivalent_diameter").select("frame_i", "label", "circularity", "roundness", flat, "extent", "equivalent_diameter")


@query(f""", {_INERTIA}, u AS (SELECT m.frame_i, m.label, (x - cx) * cos(atan2(2 * xy, xx - yy) / 2) + (y - cy) * sin(atan2(2 * xy, xx - yy) / 2) AS u,
    (y - cy) * cos(atan2(2 * xy, xx - yy) / 2) - (x - cx) * sin(atan2(2 * xy, xx - yy) / 2) AS v FROM mask m JOIN e ON e.frame_i = m.frame_i AND e.label = m.label),
  b AS (SELECT frame_i, label, floor(u - min(u) OVER (PARTITION BY frame_i, label)) AS bin, v FROM u), w AS (SELECT frame_i, label, bin, max(v) - min(v) + 1 AS w FROM b GROUP BY 1, 2, 3)
  SELECT frame_i, label, round(sum(pi() * (w / 2) ** 2) / 1000, 0) AS volume FROM w GROUP BY 1, 2""")
def rotational_volume(spark, d):
    return O.rotational_volumes(mask(spark, d)).select("frame_i", "label", F.round(F.col("cell_vol_vox") / 1000, 0).alias("volume"))


_STATS = """SELECT frame_i, label, round(avg(value), 6) AS mean, sum(value) AS sum, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.25), 6) AS q25,
    quantile_cont(value, 0.5) AS median, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.95), 6) AS q95,
    CASE WHEN count(*) < 2 OR avg(value) = 0 THEN 'nan'::DOUBLE ELSE round(stddev_pop(value) / avg(value), 6) END AS CV, count(*) AS area FROM mask WHERE label <> 0 GROUP BY 1, 2"""


@query(_STATS)
def intensity_stats(spark, d):
    return rounded(O.intensities(mask(spark, d)), "mean", "CV", "q05", "q25", "q75", "q95")


@query("SELECT frame_i, quantile_cont(value, 0.5) AS bkgr_median, round(avg(value), 6) AS bkgr_mean, count(*) AS n_bkgr FROM mask WHERE label = 0 GROUP BY 1")
def auto_background(spark, d):
    return rounded(X.background(mask(spark, d)), "bkgr_mean")


@query(f""", s AS ({_STATS}), a AS (SELECT frame_i, quantile_cont(value, 0.5) AS b FROM mask WHERE label = 0 GROUP BY 1),
  r AS (SELECT frame_i, quantile_cont(value, 0.5) AS b FROM mask WHERE label = 0 AND y < 8 AND x < 8 GROUP BY 1),
  n AS (SELECT frame_i, label, avg(value) AS b FROM (SELECT frame_i, y, (x + 3) % 24 AS x, label FROM mask WHERE label <> 0) JOIN (SELECT frame_i, y, x, value FROM mask) USING (frame_i, y, x) GROUP BY 1, 2),
  t AS (SELECT frame_i, label, avg(value) AS m FROM mask WHERE label <> 0 GROUP BY 1, 2)
  SELECT s.frame_i, s.label, round((m - a.b) * area, 4) AS amount_autoBkgr, round((m - r.b) * area, 4) AS amount_dataPrepBkgr, round((m - n.b) * area, 4) AS amount_manualBkgr
  FROM s JOIN t USING (frame_i, label) JOIN a USING (frame_i) JOIN r USING (frame_i) JOIN n USING (frame_i, label)""")
def corrected_amounts(spark, d):
    m = mask(spark, d)
    second = m.where("label <> 0").select("frame_i", "y", ((F.col("x") + 3) % 24).alias("x"), "label")
    out = O.corrected(m, roi=X.inside(0, 0, 8, 8), manual=second)
    named = {c: F.round(c, 4) for c in ("amount_autoBkgr", "amount_dataPrepBkgr", "amount_manualBkgr")}
    return out.select("frame_i", "label", *(v.alias(k) for k, v in named.items())).where("not isnan(amount_manualBkgr) and not isnan(amount_dataPrepBkgr)")


@query("""SELECT frame_i, label, """ + ", ".join(f"count(*) FILTER (z = {z}) AS cell_area_pxl_zslice{z}, count(*) FILTER (z = {z}) * 0.25::DOUBLE AS cell_area_um2_zslice{z}" for z in range(7)) + " FROM volume WHERE label <> 0 GROUP BY 1, 2", "volume")
def zslice_sizes(spark, d):
    return X.slice_sizes(volume(spark, d), 7, 0.25)


@query("SELECT frame_i, y, x, max(value) AS value FROM volume GROUP BY 1, 2, 3", "volume")
def z_project_max(spark, d):
    return X.project(volume(spark, d), "max")


@query("SELECT frame_i, y, x, round(avg(value), 6) AS value FROM volume GROUP BY 1, 2, 3", "volume")
def z_project_mean(spark, d):
    return rounded(X.project(volume(spark, d), "mean"), "value")


@query("SELECT frame_i, y, x, list_sort(list(value))[count(*) // 2 + 1] AS value FROM volume GROUP BY 1, 2, 3", "volume")
def z_project_median(spark, d):
    return X.project(volume(spark, d), "median")


@query("SELECT frame_i, y, x, value FROM volume WHERE z = 3", "volume")
def z_project_single(spark, d):
    return X.project(volume(spark, d), "single", 3)


@query("SELECT frame_i, y, x, arg_max(label, z) AS label FROM volume WHERE label <> 0 GROUP BY 1, 2, 3", "volume")
def mask_project_last(spark, d):
    return X.project_labels(volume(spark, d))


@query("SELECT frame_i, y, x, max(label) AS label FROM volume WHERE label <> 0 GROUP BY 1, 2, 3", "volume")
def mask_project_largest(spark, d):
    return X.project_labels(volume(spark, d), "largest")


@query("SELECT frame_i, z, x, max(value) AS value FROM volume WHERE frame_i = 1 GROUP BY 1, 2, 3", "volume")
def frame_view_xz(spark, d):
    return X.view_plane(volume(spark, d).where("frame_i = 1"), "XZ")


@query(""", s AS (SELECT frame_i, label, list_sort(list(DISTINCT z)) AS zs FROM volume WHERE label <> 0 GROUP BY 1, 2), m AS (SELECT *, zs[len(zs) // 2 + 1] AS mid FROM s),
  p AS (SELECT v.frame_i, v.label, v.y, v.x, unnest(range(zs[1], zs[-1] + 1)) AS z FROM volume v JOIN m ON m.frame_i = v.frame_i AND m.label = v.label AND m.mid = v.z)
  SELECT frame_i, z, y, x, max(label) AS label FROM p GROUP BY 1, 2, 3, 4""", "volume")
def connect_3d(spark, d):
    return X.connect_3d(volume(spark, d))


@query("SELECT frame_i, y, x, label, value, unnest(range(3)) AS z FROM mask WHERE label <> 0")
def stack_2d_to_3d(spark, d):
    return X.stack_to_3d(mask(spark, d).where("label <> 0"), 3)


@query("SELECT m.frame_i, m.y, m.x, m.label FROM mask m SEMI JOIN (SELECT frame_i, label FROM mask WHERE label <> 0 AND y % 5 = 0 AND x % 5 = 0 AND frame_i < 5) t ON t.frame_i = m.frame_i AND t.label = m.label")
def filter_by_coords(spark, d):
    m = mask(spark, d)
    return X.filter_by_points(m, m.where("y % 5 = 0 and x % 5 = 0 and frame_i < 5")).select("frame_i", "y", "x", "label")


@query("SELECT frame_i, y, x, label FROM mask WHERE y < 6")
def labels_at_points(spark, d):
    m = mask(spark, d)
    return X.labels_at(m, m.where("y < 6").select("frame_i", "y", "x"))


@query("SELECT m.frame_i, m.label, m.y, m.x FROM mask m ANTI JOIN (SELECT DISTINCT frame_i, label FROM mask WHERE label <> 0 AND NOT (y >= 1 AND y < 24 AND x >= 0 AND x < 23)) o ON o.frame_i = m.frame_i AND o.label = m.label WHERE m.label <> 0")
def roi_filter(spark, d):
    return X.drop_outside(mask(spark, d), X.inside(1, 0, 24, 23)).select("frame_i", "label", "y", "x")


@query("SELECT m.frame_i, m.label, m.y, m.x FROM mask m ANTI JOIN (SELECT DISTINCT frame_i, label FROM mask WHERE label <> 0 AND (y * x) % 97 = 1) o ON o.frame_i = m.frame_i AND o.label = m.label WHERE m.label <> 0")
def freehand_roi_filter(spark, d):
    m = mask(spark, d)
    every = spark.range(24).select(F.col("id").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("x"))
    return X.drop_outside(m, every.where("(y * x) % 97 <> 1")).select("frame_i", "label", "y", "x")


@query("SELECT frame_i, y, x, CASE WHEN label = 3 THEN 30 WHEN label = 4 THEN 3 ELSE label END AS label, value FROM mask WHERE label NOT IN (0, 5)")
def remap_ids(spark, d):
    m = mask(spark, d).where("label <> 0")
    new = F.when(F.col("label") == 3, 30).when(F.col("label") == 4, 3).when(F.col("label") == 5, 0)
    mapping = m.select("frame_i", "label").distinct().withColumn("new_label", new).where("new_label is not null")
    return X.remap(m, mapping).select("frame_i", "y", "x", F.col("label").cast("long").alias("label"), "value")


@query("""SELECT frame_i, y, x, label FROM mask WHERE label <> 0 AND NOT (frame_i = 2 AND (y - 10) ** 2 + (x - 10) ** 2 <= 9)
  UNION ALL SELECT 2, 10 + a, 10 + b, 9 FROM (SELECT unnest(range(-3, 4)) AS a), (SELECT unnest(range(-3, 4)) AS b) WHERE a * a + b * b <= 9""")
def paint_label(spark, d):
    return X.paint(mask(spark, d).where("label <> 0").select("frame_i", "y", "x", "label"), 10, 10, 3.0, 9, {"frame_i": 2})


@query("SELECT frame_i, y, x, CASE WHEN label = 2 AND frame_i >= 3 THEN 12 ELSE label END AS label FROM mask WHERE label <> 0")
def relabel_object(spark, d):
    m = mask(spark, d).where("label <> 0").select("frame_i", "y", "x", "label")
    return X.relabel(m, 2, 12, F.col("frame_i") >= 3).withColumn("label", F.col("label").cast("long"))


@query(""", e AS (SELECT frame_i, min(value) AS a, max(value) AS b FROM mask GROUP BY 1) SELECT frame_i, y, x, label, CASE WHEN a = b THEN 0 ELSE round((value - a) / (b - a), 6) END::DOUBLE AS value FROM mask JOIN e USING (frame_i)""")
def min_max_rescale(spark, d):
    return rounded(X.rescale(mask(spark, d), keys=["frame_i"]), "value")


@query("SELECT frame_i, y, x, CASE WHEN value > 100 THEN 0.0 ELSE 1.0 END::DOUBLE AS value FROM mask")
def binarize_inverse(spark, d):
    m = mask(spark, d).select("frame_i", "y", "x", (F.col("value") - 100).alias("value"))
    return X.binarize(m, "Inverse binarize")


@query("SELECT frame_i, y, x, CAST(round(least(greatest(value / 1000, 0), 1) * 255) AS BIGINT) AS value FROM mask")
def integer_scaling(spark, d):
    return mask(spark, d).select("frame_i", "y", "x", X.from_unit(F.col("value") / 1000, 8).alias("value"))


@query("SELECT frame_i, y, x, CAST((CAST(value AS FLOAT) + CAST(label AS FLOAT) * 2::FLOAT) - (-CAST(value AS FLOAT)) * 4::FLOAT AS DOUBLE) AS value FROM mask")
def array_formula(spark, d):
    m = mask(spark, d)
    out = X.channel_formula({"a": m, "b": m.drop("value").withColumn("value", F.col("label").cast("double"))}, "(a + b * 2) - -a * 4")
    return out.withColumn("value", F.col("value").cast("double"))


@query("""SELECT frame_i, y, x, CAST(value > 0 AND label > 0 AS INTEGER)::DOUBLE AS value FROM mask""")
def combine_channels(spark, d):
    m = mask(spark, d)
    flags = m.select("frame_i", "y", "x", F.col("label").cast("double").alias("value"))
    return X.combine_channels({"a": (m.select("frame_i", "y", "x", "value"), "binarize"), "b": (flags, "binarize")}, "a * b", segmentation=True)


@query("SELECT frame_i, y + frame_i AS y, x - 2 AS x, label FROM mask WHERE label <> 0 AND y + frame_i < 24 AND x >= 2")
def shift_frames(spark, d):
    m = mask(spark, d).where("label <> 0").select("frame_i", "y", "x", "label")
    shifts = m.select("frame_i").distinct().select("frame_i", F.col("frame_i").alias("dy"), F.lit(-2).alias("dx"))
    return X.shift(m, shifts, 24, 24)


_SHIFTED = """, n AS (SELECT {keys}frame_i, y, x, value - avg(value) OVER (PARTITION BY {keys}frame_i) AS v FROM ({view})), f AS (SELECT {keys}min(frame_i) AS first FROM n GROUP BY ALL),
  c AS (SELECT {s_keys}s.frame_i, r.y - s.y AS dy, r.x - s.x AS dx, avg(s.v * r.v) AS score FROM n s JOIN f ON {f_on} s.frame_i <> f.first
    JOIN n r ON {r_on} r.frame_i = f.first AND abs(r.y - s.y) <= {most} AND abs(r.x - s.x) <= {most} GROUP BY ALL)"""


@query(_SHIFTED.format(keys="", s_keys="", f_on="", r_on="", view="SELECT * FROM mask", most=16) + " SELECT frame_i, round(max(score), 3) AS score FROM c GROUP BY 1")
def alignment_scores(spark, d):
    m = mask(spark, d)
    best = L.best_shifts(m, 16)
    w = Window.partitionBy("frame_i")
    n = m.withColumn("v", F.col("value") - F.avg("value").over(w))
    at = n.join(best, "frame_i").select("frame_i", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "v")
    ref = n.where("frame_i = 0").select("y", "x", F.col("v").alias("r"))
    return at.join(ref, ["y", "x"]).groupBy("frame_i").agg(F.round(F.avg(F.col("v") * F.col("r")), 3).alias("score"))


@query(_SHIFTED.format(keys="place, ", s_keys="s.place, ", f_on="f.place = s.place AND", r_on="r.place = s.place AND", view="SELECT *, CAST(substr(position, 10) AS BIGINT) AS place FROM scenes", most=6)
       + " SELECT 'Position_' || place AS position, frame_i, arg_max(dy, (score, -(abs(dy) + abs(dx)), -dy, -dx)) AS dy, arg_max(dx, (score, -(abs(dy) + abs(dx)), -dy, -dx)) AS dx FROM c GROUP BY place, frame_i", "scenes")
def alignment_shifts(spark, d):
    return L.best_shifts(table(spark, d, "scenes"), 6, ["position"])


@query("SELECT frame_i - 1 AS frame_i, y - 4 AS y, x - 2 AS x, label FROM mask WHERE frame_i >= 1 AND frame_i < 5 AND y >= 4 AND y < 20 AND x >= 2 AND x < 9")
def crop_ranges(spark, d):
    return X.crop(mask(spark, d), frames=(1, 5), box=(4, 2, 20, 9)).select("frame_i", "y", "x", "label")


@query("""SELECT CAST(roi_id AS INTEGER) AS roi_id, frame_i, y - t AS y, x - l AS x, value FROM mask, (VALUES (0, 0, 0, 10, 10), (1, 5, 5, 24, 12)) r(roi_id, t, l, b, r) WHERE y >= t AND y < b AND x >= l AND x < r""")
def crop_rois(spark, d):
    return X.crop_rois(mask(spark, d), [(0, 0, 0, 10, 10), (1, 5, 5, 24, 12)]).select("roi_id", "frame_i", "y", "x", "value")


@query(""", r AS (SELECT frame_i, label, avg(y) AS cy, avg(x) AS cx FROM mask WHERE label <> 0 GROUP BY 1, 2)
  SELECT a.frame_i, a.label, coalesce(round(sqrt((a.cy - b.cy) ** 2 + (a.cx - b.cx) ** 2), 6), 'nan'::DOUBLE) AS velocity_pixel,
    coalesce(round(sqrt(((a.cy - b.cy) * 0.25) ** 2 + ((a.cx - b.cx) * 0.5) ** 2), 6), 'nan'::DOUBLE) AS velocity_um FROM r a LEFT JOIN r b ON b.label = a.label AND b.frame_i = a.frame_i - 1""")
def velocity(spark, d):
    return rounded(O.velocities(O.regions(mask(spark, d)), 0.25, 0.5), "velocity_pixel", "velocity_um").select("frame_i", "label", "velocity_pixel", "velocity_um")


@query(""", o AS (SELECT DISTINCT frame_i, label FROM mask WHERE label <> 0) SELECT o.frame_i, o.label, CAST(o.frame_i < 6 AND n.label IS NULL AS INTEGER) AS disappears_before_end
  FROM o LEFT JOIN o n ON n.label = o.label AND n.frame_i = o.frame_i + 1""")
def disappearance(spark, d):
    return O.disappearances(mask(spark, d), 7)


@query("SELECT frame_i, label, count(*) AS area, round(avg(y), 6) AS centroid_y, round(avg(x), 6) AS centroid_x, min(y) AS y_min, min(x) AS x_min, max(y) AS y_max, max(x) AS x_max, round(avg(value), 6) AS mean, sum(value) AS sum FROM mask WHERE frame_i = 2 AND label = 4 GROUP BY 1, 2")
def inspect_object(spark, d):
    return rounded(O.inspect(mask(spark, d), 2, 4), "centroid_y", "centroid_x", "mean")


@query(f""", s AS ({_STATS}), {_PERIMETER}, b AS (SELECT frame_i, quantile_cont(value, 0.5) AS b FROM mask WHERE label = 0 GROUP BY 1), m AS (SELECT frame_i, label, avg(value) AS m FROM mask WHERE label <> 0 GROUP BY 1, 2)
  SELECT s.frame_i, label AS Cell_ID, area AS cell_area_pxl, area * 0.125 AS cell_area_um2, frame_i * 15.0::DOUBLE AS time_seconds, perimeter, mean AS gfp_mean, median AS gfp_median, round((m - b) * area, 4) AS gfp_amount_autoBkgr, 'G1' AS cell_cycle_stage,
    -1 AS relative_ID FROM s JOIN p USING (frame_i, label) JOIN b USING (frame_i) JOIN m USING (frame_i, label)""")
def measure_position(spark, d):
    out = O.measure({"gfp": mask(spark, d)}, 7, 15.0, 0.25, 0.5, skip=["q05", "gfp_max"])
    assert "gfp_q05" not in out.columns
    out = rounded(out, "gfp_mean").withColumn("gfp_amount_autoBkgr", F.round("gfp_amount_autoBkgr", 4))
    return out.select("frame_i", "Cell_ID", "cell_area_pxl", "cell_area_um2", "time_seconds", "perimeter", "gfp_mean", "gfp_median", "gfp_amount_autoBkgr", "cell_cycle_stage", "relative_ID")
