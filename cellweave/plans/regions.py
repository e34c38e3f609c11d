"""Queries of regions, of measuring with backgrounds and in depth, and of orders, over positions that grow with the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import areas as A
from cellweave.operators import objects as O
from cellweave.operators import tiles as T
from cellweave.plans.adapters import oracle, table
from cellweave.plans.forests import _FREE

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None, *views: str):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = (f, sql and oracle(sql, *views).replace("WITH ", "WITH RECURSIVE " if "walk" in sql else "WITH ", 1))
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


_IN = 'y >= r.top AND y < r.bottom AND x >= r."left" AND x < r."right"'
_CROPPED = f'SELECT s.position, r.roi_id, frame_i, y - greatest(r.top, 0) AS y, x - greatest(r."left", 0) AS x, label, value FROM scenes s JOIN rois r ON r.position = s.position AND {_IN}'


@query(_CROPPED, "scenes", "rois")
def crop_regions(spark, d):
    return A.crop_regions(table(spark, d, "scenes"), table(spark, d, "rois"))


_TARGETS = """, p AS (SELECT *, CAST(substr(position, 10) AS BIGINT) AS place, count(*) OVER (PARTITION BY position) AS n FROM rois),
  g AS (SELECT *, max(place) OVER () + CAST(row_number() OVER (PARTITION BY n > 1 ORDER BY place, roi_id) AS BIGINT) AS new FROM p),
  t AS (SELECT position, roi_id, top, "left", bottom, "right", CASE WHEN n = 1 THEN position ELSE 'Position_' || new END AS target FROM g)"""


@query(f"{_TARGETS} SELECT * FROM t", "rois")
def region_positions(spark, d):
    rois = table(spark, d, "rois")
    return A.new_positions(rois, rois.select("position").distinct())


@query(f"""{_TARGETS}, i AS (SELECT t.target AS position, r.roi_id AS n, least(greatest(greatest(r.top + 2, 0) - greatest(t.top, 0), 0), t.bottom - greatest(t.top, 0)) AS top,
    least(greatest(greatest(r."left" + 1, 0) - greatest(t."left", 0), 0), t."right" - greatest(t."left", 0)) AS "left", least(greatest(r.bottom + 2 - greatest(t.top, 0), 0), t.bottom - greatest(t.top, 0)) AS bottom,
    least(greatest(r."right" + 1 - greatest(t."left", 0), 0), t."right" - greatest(t."left", 0)) AS "right" FROM rois r JOIN t ON t.position = r.position)
  SELECT * FROM i WHERE bottom > top AND "right" > "left" """, "rois")
def clipped_regions(spark, d):
    rois = table(spark, d, "rois")
    inner = rois.select("position", F.col("roi_id").alias("n"), (F.col("top") + 2).alias("top"), (F.col("left") + 1).alias("left"), (F.col("bottom") + 2).alias("bottom"), (F.col("right") + 1).alias("right"))
    return A.clipped(inner, A.new_positions(rois, rois.select("position").distinct()))


@query(f"WITH c AS ({_CROPPED}) SELECT position, 'roi' || roi_id || '_data' AS name, frame_i, y, x, value FROM c".replace("WITH c AS", ", c AS"), "scenes", "rois")
def region_archives(spark, d):
    pixels = table(spark, d, "scenes").select("position", "frame_i", "y", "x", "value")
    return A.archives(pixels, table(spark, d, "rois")).select("position", "name", "frame_i", "y", "x", "value")


def _levels(name: str, alias: str) -> str:
    return ", ".join(f"coalesce({alias}.{c}, 'nan'::DOUBLE) AS {name}_{c}" for c in ("median", "mean", "q75", "q05"))


_FIGURES = "quantile_cont(value, 0.5) AS median, avg(value) AS mean, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.05) AS q05"
_BACKGROUNDS = f""", o AS (SELECT position, frame_i, label, count(*) AS area, avg(value) AS m FROM scenes WHERE label <> 0 GROUP BY 1, 2, 3),
  a AS (SELECT position, frame_i, {_FIGURES} FROM scenes WHERE label = 0 GROUP BY 1, 2),
  inside AS (SELECT s.* FROM scenes s WHERE label = 0 AND EXISTS (SELECT 1 FROM rois r WHERE r.position = s.position AND {_IN})),
  archive AS (SELECT s.* FROM scenes s JOIN rois r ON r.position = s.position AND {_IN} WHERE s.frame_i = 3),
  given AS (SELECT position, frame_i, value FROM archive UNION ALL SELECT position, frame_i, value FROM inside i WHERE NOT EXISTS (SELECT 1 FROM archive x WHERE x.position = i.position AND x.frame_i = i.frame_i)),
  d AS (SELECT position, frame_i, {_FIGURES} FROM given GROUP BY 1, 2),
  n AS (SELECT s.position, s.frame_i, l.label, {_FIGURES} FROM (SELECT position, frame_i, y, (x + 5) % 48 AS x, label FROM scenes WHERE label <> 0 AND label <> 7) l JOIN scenes s USING (position, frame_i, y, x) GROUP BY 1, 2, 3)"""


@query(f"""{_BACKGROUNDS} SELECT o.position, o.frame_i, o.label AS Cell_ID, {", ".join(f"round(coalesce({t}.{c}, 'nan'::DOUBLE), 6) AS gfp_{k}_bkgrVal_{c}" for t, k in (("a", "autoBkgr"), ("d", "dataPrepBkgr"), ("n", "manualBkgr")) for c in ("median", "mean", "q75", "q05"))},
    round(coalesce((m - a.median) * area, 'nan'::DOUBLE), 6) AS gfp_amount_autoBkgr, round(coalesce((m - d.median) * area, 'nan'::DOUBLE), 6) AS gfp_amount_dataPrepBkgr, round(coalesce((m - n.mean) * area, 'nan'::DOUBLE), 6) AS gfp_amount_manualBkgr,
    round(coalesce(m - n.mean, 'nan'::DOUBLE), 6) AS gfp_mean_manualBkgr
  FROM o LEFT JOIN a USING (position, frame_i) LEFT JOIN d USING (position, frame_i) LEFT JOIN n USING (position, frame_i, label)""", "scenes", "rois")
def measured_backgrounds(spark, d):
    pixels, rois = table(spark, d, "scenes"), table(spark, d, "rois")
    archive = A.archives(pixels.where("frame_i = 3").select("position", "frame_i", "y", "x", "value"), rois)
    second = pixels.where("label <> 0 and label <> 7").select("position", "frame_i", "y", ((F.col("x") + 5) % 48).alias("x"), "label")
    out = O.measure({"gfp": pixels}, 7, keys=["position"], rois=rois, archives={"gfp": archive}, manual=second, sizes=[], regionprops=[])
    shown = [f"gfp_{b}_bkgrVal_{c}" for b in ("autoBkgr", "dataPrepBkgr", "manualBkgr") for c in ("median", "mean", "q75", "q05")]
    shown += ["gfp_amount_autoBkgr", "gfp_amount_dataPrepBkgr", "gfp_amount_manualBkgr", "gfp_mean_manualBkgr"]
    return rounded(out.select("position", "frame_i", "Cell_ID", *shown), *shown)


_DEEP = """, v AS (SELECT position, frame_i, label, CAST(count(*) AS DOUBLE) AS n, avg(value) AS m, max(value) AS top, quantile_cont(value, 0.25) AS q25 FROM stacks WHERE label <> 0 GROUP BY 1, 2, 3),
  b AS (SELECT position, frame_i, quantile_cont(value, 0.5) AS b FROM stacks WHERE label = 0 GROUP BY 1, 2),
  f AS (SELECT position, frame_i, y, x, arg_max(label, z) FILTER (label <> 0) AS label, max(value) AS hi, avg(value) AS av, max(value) FILTER (z = 3) AS mid FROM stacks GROUP BY 1, 2, 3, 4),
  p AS (SELECT position, frame_i, label, count(*) AS area, avg(hi) AS hi, avg(av) AS av, avg(mid) AS mid FROM f WHERE label <> 0 GROUP BY 1, 2, 3),
  z AS (SELECT position, frame_i, label, """ + ", ".join(f"count(*) FILTER (z = {z}) AS z{z}" for z in (0, 6)) + """ FROM stacks WHERE label <> 0 GROUP BY 1, 2, 3)"""


@query(f"""{_DEEP} SELECT position, frame_i, label AS Cell_ID, p.area AS cell_area_pxl, v.n AS "cell_vol_vox_3D", round(v.n * 0.5 * 0.25 * 0.25, 6) AS "cell_vol_fl_3D", z0 AS cell_area_pxl_zslice0, z6 AS cell_area_pxl_zslice6,
    round(p.hi, 6) AS "gfp_mean_maxProj", round(p.av, 6) AS "gfp_mean_meanProj", round(p.mid, 6) AS "gfp_mean_zSlice", round(v.m, 6) AS "gfp_mean_3D", v.top AS "gfp_max_3D", round(v.q25, 6) AS "gfp_q25_3D",
    round((v.m - b.b) * v.n, 6) AS "gfp_amount_autoBkgr_3D", round((v.m - b.b) * v.n / (v.n * 0.5 * 0.25 * 0.25), 6) AS "gfp_concentration_autoBkgr_from_vol_fl_3D"
  FROM p JOIN v USING (position, frame_i, label) JOIN z USING (position, frame_i, label) LEFT JOIN b USING (position, frame_i) WHERE p.mid IS NOT NULL""", "stacks")
def measured_volumes(spark, d):
    stacks = table(spark, d, "stacks")
    at = ["position", "frame_i"]
    flat = stacks.where("label <> 0").groupBy(*at, "y", "x").agg(F.max_by("label", "z").alias("label"))
    parts = O.variants(stacks.drop("label"), flat, 3, ["position"], labels_3d=stacks.where("label <> 0"))
    out = O.measure({"gfp": parts}, 2, size_y=0.25, size_x=0.25, size_z=0.5, keys=["position"], slice_count=7, regionprops=[], skip=["concentration_autoBkgr_from_vol_vox"])
    sizes = ["cell_vol_fl_3D", "gfp_mean_maxProj", "gfp_mean_meanProj", "gfp_mean_zSlice", "gfp_mean_3D", "gfp_q25_3D", "gfp_amount_autoBkgr_3D", "gfp_concentration_autoBkgr_from_vol_fl_3D"]
    return rounded(out.select(*at, "Cell_ID", "cell_area_pxl", "cell_vol_vox_3D", "cell_area_pxl_zslice0", "cell_area_pxl_zslice6", "gfp_max_3D", *sizes), *sizes)


@query(""", o AS (SELECT DISTINCT position, frame_i, label FROM scenes WHERE label <> 0 AND (frame_i + label) % 5 <> 0), e AS (SELECT DISTINCT position, 3 + CAST(substr(position, 10) AS BIGINT) % 4 AS n FROM scenes)
  SELECT o.position, o.frame_i, o.label, CAST(o.frame_i < e.n - 1 AND f.label IS NULL AS INTEGER) AS disappears_before_end
  FROM o JOIN e USING (position) LEFT JOIN o f ON f.position = o.position AND f.label = o.label AND f.frame_i = o.frame_i + 1 AND f.frame_i < e.n WHERE o.frame_i < e.n""", "scenes")
def position_disappearances(spark, d):
    pixels = table(spark, d, "scenes").where("(frame_i + label) % 5 <> 0")
    ends = pixels.select("position").distinct().withColumn("n_frames", 3 + F.expr("cast(substr(position, 10) as bigint)") % 4)
    cut = pixels.join(ends, "position").where("frame_i < n_frames").drop("n_frames")
    return O.disappearances(cut, ends, ["position"])


@query(""", p AS (SELECT CAST(substr(position, 10) AS BIGINT) AS place, frame_i, y, x, y * 48 + x AS spot FROM scenes WHERE value > 30),
  walk AS (SELECT place, frame_i, spot, spot AS reached, y, x FROM p UNION SELECT w.place, w.frame_i, w.spot, n.spot, n.y, n.x FROM walk w JOIN p n ON n.place = w.place AND n.frame_i = w.frame_i AND abs(n.y - w.y) + abs(n.x - w.x) = 1),
  f AS (SELECT place, frame_i, spot, min(reached) AS first FROM walk GROUP BY ALL)
  SELECT 'Position_' || place AS position, frame_i, spot // 48 AS y, spot % 48 AS x, dense_rank() OVER (PARTITION BY place, frame_i ORDER BY first) AS label FROM f""", "scenes")
def tiled_segments(spark, d):
    return T.segment_above(table(spark, d, "scenes"), 30.0, ["position", "frame_i"], tile=16)


@query(_FREE + " SELECT 'Position_' || place AS position, frame_i, y, x, label FROM filled", "scenes")
def tiled_hole_filling(spark, d):
    return T.fill_holes(table(spark, d, "scenes"), ["position", "frame_i"], tile=16)
