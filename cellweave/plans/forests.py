"""Queries of tracking, lineage, z-slice choices and neighbourhood operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import lineage as L
from cellweave.operators import planes as N
from cellweave.operators import slices as Z
from cellweave.operators import tracking as K
from cellweave.plans.adapters import oracle, table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None, *views: str):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = (f, sql and oracle(sql, *(views or ("mask",))).replace("WITH ", "WITH RECURSIVE " if "walk" in sql else "WITH ", 1))
        return f

    return add


def mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mask")


_OVERLAPS = """o AS (SELECT c.frame_i, c.label AS curr, p.label AS prev, count(*) AS n FROM mask c JOIN mask p ON p.frame_i = c.frame_i - 1 AND p.y = c.y AND p.x = c.x
    WHERE c.label <> 0 AND p.label <> 0 GROUP BY 1, 2, 3), a AS (SELECT frame_i, label, count(*) AS area FROM mask WHERE label <> 0 GROUP BY 1, 2),
  i AS (SELECT o.*, CAST(n / {area}::DOUBLE AS FLOAT) AS ioa FROM o JOIN a p ON p.frame_i = o.frame_i - 1 AND p.label = o.prev JOIN a c ON c.frame_i = o.frame_i AND c.label = o.curr)"""


@query(f", {_OVERLAPS.format(area='p.area')} SELECT frame_i, curr, prev, n, CAST(round(CAST(ioa AS DOUBLE), 5) AS DOUBLE) AS ioa FROM i")
def overlap_ioa(spark, d):
    return K.overlaps(mask(spark, d)).withColumn("ioa", F.round(F.col("ioa").cast("double"), 5))


_ASSIGN = """, {o}, l AS (SELECT a.frame_i, min(b.label) AS lp, min(a.label) AS lc FROM a JOIN a b ON b.frame_i = a.frame_i - 1 GROUP BY 1),
  b AS (SELECT a.frame_i, a.label AS curr, lc, coalesce((SELECT i.prev FROM i WHERE i.frame_i = a.frame_i AND i.curr = a.label ORDER BY ioa DESC, i.prev LIMIT 1), lp) AS prev,
    coalesce((SELECT max(ioa) FROM i WHERE i.frame_i = a.frame_i AND i.curr = a.label), 0) AS ioa FROM a JOIN l USING (frame_i)),
  t AS (SELECT *, count(*) OVER (PARTITION BY frame_i, prev) AS k FROM b)
  SELECT frame_i, CASE WHEN k = 1 THEN curr ELSE coalesce((SELECT i.curr FROM i WHERE i.frame_i = t.frame_i AND i.prev = t.prev ORDER BY i.ioa DESC, i.curr LIMIT 1), lc) END AS old_id, prev AS new_id FROM t
  WHERE ioa >= CAST({th} AS FLOAT)"""


@query(_ASSIGN.format(o=_OVERLAPS.format(area="p.area"), th=0.1))
def ioa_assignment(spark, d):
    return K.assignments(mask(spark, d), 0.1).drop("ioa")


@query(_ASSIGN.format(o=_OVERLAPS.format(area="(p.area + c.area - o.n)"), th=0.05))
def ioa_assignment_union(spark, d):
    return K.assignments(mask(spark, d), 0.05, denominator="union").drop("ioa")


@query()
def track_sequence(spark, d):
    return K.track(table(spark, d, "scenes"), threshold=0.1)


@query()
def repeat_tracking(spark, d):
    out = K.repeat_and_measure({"gfp": table(spark, d, "scenes")}, 3, 7, threshold=0.1, sizes=["cell_area_pxl"], regionprops=[], save=["mean"])
    return out.select("position", "frame_i", "Cell_ID", "cell_area_pxl", "gfp_mean")


@query(""", o AS (SELECT DISTINCT position, frame_i, label FROM scenes WHERE label <> 0 AND (frame_i + label) % 5 <> 0), e AS (SELECT position, max(frame_i) AS last FROM o GROUP BY 1)
  SELECT o.* FROM o JOIN e USING (position) WHERE frame_i < last AND NOT EXISTS (SELECT 1 FROM o n WHERE n.position = o.position AND n.frame_i = o.frame_i + 1 AND n.label = o.label)""", "scenes")
def track_disappearances(spark, d):
    return K.disappeared(table(spark, d, "scenes").where("label <> 0 and (frame_i + label) % 5 <> 0"))


_TRACKS = """, t AS (SELECT frame_i, label, min(y * 24 + x) AS track_id FROM mask WHERE label <> 0 AND y % 3 = 0 AND label <> 5 GROUP BY 1, 2), f AS (SELECT DISTINCT frame_i FROM t)"""


@query(_TRACKS + """, o AS (SELECT DISTINCT frame_i, label FROM mask WHERE label <> 0)
  SELECT frame_i, label, coalesce(track_id, 0) AS new_label FROM o LEFT JOIN t USING (frame_i, label) WHERE frame_i IN (SELECT frame_i FROM f)""")
def tracking_table_mapping(spark, d):
    m = mask(spark, d)
    points = m.where("label <> 0 and y % 3 = 0 and label <> 5").select("frame_i", "y", "x", (F.col("y") * 24 + F.col("x")).alias("track_id"))
    return K.mapping_of_table(m, points, delete_untracked=True)


@query("""SELECT o.position, o.frame_i, CASE WHEN Cell_ID % 4 = 0 THEN Cell_ID + 1000000 ELSE Cell_ID END AS Cell_ID,
    CASE WHEN relative_ID % 4 = 0 AND relative_ID >= 0 AND EXISTS (SELECT 1 FROM objects m WHERE m.frame_i = o.frame_i AND m.Cell_ID = o.relative_ID) THEN relative_ID + 1000000 ELSE relative_ID END AS relative_ID
  FROM objects o WHERE NOT (frame_i = 2 AND Cell_ID % 7 = 0)""", "objects")
def tracking_mappers(spark, d):
    o = table(spark, d, "objects")
    first = o.where("Cell_ID % 4 = 0").select("frame_i", F.col("Cell_ID").alias("label"), (F.col("Cell_ID") + 1000000).alias("new_label")).distinct()
    second = first.withColumn("new_label", F.lit(-5).cast("long"))
    gone = o.where("frame_i = 2 and Cell_ID % 7 = 0").select("frame_i", F.col("Cell_ID").alias("label"))
    return K.apply_mappers(o, first, second, gone).select("position", "frame_i", "Cell_ID", "relative_ID")


@query(""", n AS (SELECT c.* FROM lineage c ANTI JOIN lineage p ON p.position = c.position AND p.frame_i = c.frame_i - 1 AND p.Cell_ID = c.Cell_ID WHERE c.frame_i > 0)
  SELECT position, frame_i, 'with parent' AS kind, Cell_ID, parent_ID_tree AS parent_ID FROM n WHERE parent_ID_tree > 0
  UNION ALL SELECT position, frame_i, 'orphan', Cell_ID, -1 FROM n WHERE parent_ID_tree <= 0
  UNION ALL SELECT p.position, p.frame_i + 1, 'lost', p.Cell_ID, -1 FROM lineage p ANTI JOIN lineage c ON c.position = p.position AND c.frame_i = p.frame_i + 1 AND c.Cell_ID = p.Cell_ID
    ANTI JOIN n ON n.position = p.position AND n.frame_i = p.frame_i + 1 AND n.parent_ID_tree = p.Cell_ID AND n.parent_ID_tree > 0 WHERE p.frame_i < 4""", "lineage")
def lineage_diff(spark, d):
    return L.frame_changes(table(spark, d, "lineage"))


@query("""SELECT f.position, f.frame_i, coalesce((SELECT string_agg(CAST(p.Cell_ID AS VARCHAR), ',' ORDER BY p.Cell_ID) FROM lineage p WHERE p.position = f.position AND p.frame_i = f.frame_i - 1
    AND NOT EXISTS (SELECT 1 FROM lineage c WHERE c.position = p.position AND c.frame_i = f.frame_i AND c.Cell_ID = p.Cell_ID)), '') AS candidates FROM (SELECT DISTINCT position, frame_i FROM lineage) f""", "lineage")
def mother_candidates(spark, d):
    out = L.mother_candidates(table(spark, d, "lineage"))
    return out.withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ","))


@query("""SELECT a.position, a.frame_i, a.Cell_ID, CASE WHEN a.parent_ID_tree <= 0 THEN '' ELSE coalesce((SELECT string_agg(CAST(b.Cell_ID AS VARCHAR), ',' ORDER BY b.Cell_ID) FROM lineage b
    WHERE b.position = a.position AND b.frame_i = a.frame_i AND b.parent_ID_tree = a.parent_ID_tree AND b.Cell_ID <> a.Cell_ID), '') END AS sisters FROM lineage a""", "lineage")
def sister_lists(spark, d):
    out = L.sisters_of(table(spark, d, "lineage"))
    return out.select("position", "frame_i", "Cell_ID", F.array_join(F.col("sisters").cast("array<string>"), ",").alias("sisters"))


@query("""SELECT a.position, a.frame_i, a.Cell_ID, EXISTS (SELECT 1 FROM lineage b WHERE b.position = a.position AND b.frame_i = a.frame_i AND b.Cell_ID = a.parent_ID_tree) AS parent_there,
  coalesce((SELECT min(b.frame_i) FROM lineage b WHERE b.position = a.position AND b.Cell_ID = a.parent_ID_tree), -1) AS parent_first, (SELECT min(b.frame_i) FROM lineage b WHERE b.position = a.position AND b.Cell_ID = a.Cell_ID) AS first_frame_i FROM lineage a""", "lineage")
def lineage_parent_lookup(spark, d):
    out = L.same_frame_parents(L.first_frames(table(spark, d, "lineage")))
    return out.select("position", "frame_i", "Cell_ID", "parent_there", F.coalesce("parent_first", F.lit(-1)).alias("parent_first"), "first_frame_i")


def _forest(spark, d):
    rows = table(spark, d, "lineage")
    role = F.when(F.col("parent_ID_tree") > 0, "bud").otherwise("mother")
    cycle = rows.select("position", "frame_i", "Cell_ID", F.col("parent_ID_tree").alias("relative_ID"), role.alias("relationship"), F.lit(1).cast("long").alias("generation_num"), "_row_id")
    return L.build(cycle)


def _shown(forest):
    keep = ["position", "frame_i", "Cell_ID", "generation_num_tree", "parent_ID_tree", "root_ID_tree", "is_history_known"]
    return forest.select(*keep, F.array_join(F.col("sisters").cast("array<string>"), ",").alias("sisters"))


_SISTERS = "coalesce(array_to_string(list_filter({members}, lambda c: c <> {row}.Cell_ID), ','), '')"
_FAMILY = "(SELECT position, frame_i, parent, list(Cell_ID ORDER BY Cell_ID) AS members FROM {forest} WHERE parent > 0 GROUP BY 1, 2, 3)"
_CYCLES = f""", n AS (SELECT l.position, l.frame_i, l.Cell_ID, l._row_id, CASE WHEN l.parent_ID_tree > 0 THEN l.parent_ID_tree END AS p, coalesce(s._row_id, f._row_id) AS source, coalesce(s.parent_ID_tree, f.parent_ID_tree) AS source_p
    FROM lineage l LEFT JOIN lineage s ON s.position = l.position AND s.frame_i = l.frame_i AND s.Cell_ID = l.parent_ID_tree AND l.parent_ID_tree > 0
    LEFT JOIN (SELECT position, Cell_ID, min(_row_id) AS _row_id, arg_min(parent_ID_tree, _row_id) AS parent_ID_tree FROM lineage GROUP BY 1, 2) f ON f.position = l.position AND f.Cell_ID = l.parent_ID_tree AND l.parent_ID_tree > 0),
  walk AS (SELECT position, _row_id AS id, _row_id AS here, 0 AS hops FROM n WHERE p IS NOT NULL
    UNION ALL SELECT w.position, w.id, n.source, w.hops + 1 FROM walk w JOIN n ON n.position = w.position AND n._row_id = w.here WHERE n.source_p > 0 AND n.source < n._row_id),
  top AS (SELECT position, id, max(hops) AS hops, arg_max(here, hops) AS here FROM walk GROUP BY 1, 2),
  bare AS (SELECT n.position, n.frame_i, n.Cell_ID, n._row_id, coalesce(n.p, -1) AS parent, CASE WHEN n.p IS NULL THEN 1 ELSE 2 + t.hops END AS generation, coalesce(e.p, n.Cell_ID) AS root
    FROM n LEFT JOIN top t ON t.position = n.position AND t.id = n._row_id LEFT JOIN n e ON e.position = n.position AND e._row_id = t.here),
  forest AS (SELECT b.*, {_SISTERS.format(members="m.members", row="b")} AS sisters FROM bare b LEFT JOIN {_FAMILY.format(forest="bare")} m ON m.position = b.position AND m.frame_i = b.frame_i AND m.parent = b.parent)"""


def _regrouped_sql(forest, cells, out):
    """Sisters anew at each cell's first frame."""
    return f""", {out}_own AS (SELECT f.position, f.frame_i, f.Cell_ID, f.parent FROM {forest} f JOIN (SELECT position, Cell_ID, min(frame_i) AS frame_i FROM {forest} GROUP BY 1, 2) o USING (position, Cell_ID, frame_i) WHERE (f.position, f.Cell_ID) IN (SELECT position, Cell_ID FROM {cells})),
  {out} AS (SELECT f.* EXCLUDE (sisters), CASE WHEN (f.position, f.frame_i, f.Cell_ID) IN (SELECT position, frame_i, Cell_ID FROM {out}_own WHERE parent <= 0) THEN ''
      WHEN (f.position, f.frame_i, f.parent) IN (SELECT position, frame_i, parent FROM {out}_own WHERE parent > 0) THEN {_SISTERS.format(members="m.members", row="f")} ELSE f.sisters END AS sisters
    FROM {forest} f LEFT JOIN {_FAMILY.format(forest=forest)} m ON m.position = f.position AND m.frame_i = f.frame_i AND m.parent = f.parent)"""


_UPDATED = f"""{_CYCLES}, edits AS (SELECT position, Cell_ID, _row_id, CASE WHEN Cell_ID % 7 = 0 THEN CAST(floor(Cell_ID / 3.0) AS BIGINT) ELSE -1 END AS q FROM forest WHERE frame_i = 2 AND (Cell_ID % 7 = 0 OR Cell_ID % 11 = 0)),
  e AS (SELECT e.*, p.Cell_ID IS NOT NULL AS child, coalesce(p.generation + 1, 1) AS generation, coalesce(p.root, e.Cell_ID) AS root, x.Cell_ID IS NOT NULL AND p.Cell_ID IS NOT NULL AND e.q < e.Cell_ID AS follows
    FROM edits e LEFT JOIN forest p ON p.frame_i = 2 AND p.position = e.position AND p.Cell_ID = e.q AND e.q > 0 LEFT JOIN edits x ON x.position = e.position AND x.Cell_ID = e.q),
  walk2 AS (SELECT position, Cell_ID AS id, Cell_ID AS here, 0 AS hops FROM e
    UNION ALL SELECT w.position, w.id, e.q, w.hops + 1 FROM walk2 w JOIN e ON e.position = w.position AND e.Cell_ID = w.here WHERE e.follows),
  top2 AS (SELECT position, id, max(hops) AS hops, arg_max(here, hops) AS here FROM walk2 GROUP BY 1, 2),
  bare2 AS (SELECT f.position, f.frame_i, f.Cell_ID, f._row_id, CASE WHEN e.child THEN e.q WHEN e.Cell_ID IS NOT NULL THEN -1 ELSE f.parent END AS parent, coalesce(z.generation + t.hops, f.generation) AS generation, coalesce(z.root, f.root) AS root,
      CASE WHEN NOT e.child THEN '' ELSE f.sisters END AS sisters
    FROM forest f LEFT JOIN e ON e.position = f.position AND e._row_id = f._row_id LEFT JOIN top2 t ON t.position = e.position AND t.id = e.Cell_ID LEFT JOIN e z ON z.position = t.position AND z.Cell_ID = t.here)
  {_regrouped_sql("bare2", "edits", "updated")}"""
_PROPAGATED = f"""{_UPDATED}, moved AS (SELECT f.position, f.frame_i, f.Cell_ID, f._row_id, coalesce(s.parent, f.parent) AS parent, coalesce(s.generation, f.generation) AS generation, coalesce(s.root, f.root) AS root, coalesce(s.sisters, f.sisters) AS sisters
    FROM updated f LEFT JOIN (SELECT * FROM updated WHERE frame_i = 2 AND (position, Cell_ID) IN (SELECT position, Cell_ID FROM edits)) s ON f.frame_i > 2 AND s.position = f.position AND s.Cell_ID = f.Cell_ID),
  met AS (SELECT c.*, p._row_id AS over FROM moved c JOIN moved p ON p.position = c.position AND p.frame_i = c.frame_i AND p.Cell_ID = c.parent WHERE c.frame_i > 2 AND (p.position, p.Cell_ID) IN (SELECT position, Cell_ID FROM edits)),
  walk3 AS (SELECT position, _row_id AS id, over AS here, 1 AS hops FROM met UNION ALL SELECT w.position, w.id, m.over, w.hops + 1 FROM walk3 w JOIN met m ON m.position = w.position AND m._row_id = w.here),
  top3 AS (SELECT position, id, max(hops) AS hops, arg_max(here, hops) AS here FROM walk3 GROUP BY 1, 2),
  bare3 AS (SELECT f.position, f.frame_i, f.Cell_ID, f._row_id, f.parent, coalesce(z.generation + t.hops, f.generation) AS generation, coalesce(z.root, f.root) AS root, f.sisters
    FROM moved f LEFT JOIN top3 t ON t.position = f.position AND t.id = f._row_id LEFT JOIN moved z ON z.position = t.position AND z._row_id = t.here),
  touched AS (SELECT position, Cell_ID FROM edits UNION SELECT position, Cell_ID FROM met)
  {_regrouped_sql("bare3", "touched", "propagated")}"""
_FOREST = " SELECT position, frame_i, Cell_ID, generation AS generation_num_tree, parent AS parent_ID_tree, root AS root_ID_tree, parent > 0 AS is_history_known, sisters FROM "


@query(f"{_CYCLES}{_FOREST}forest", "lineage")
def lineage_from_cycles(spark, d):
    return _shown(_forest(spark, d))


def _edits(forest):
    """Every seventh cell of frame 2 gets another parent, every eleventh none, in all positions."""
    parent = F.when(F.col("Cell_ID") % 7 == 0, F.floor(F.col("Cell_ID") / 3)).otherwise(-1)
    return forest.where("frame_i = 2 and (Cell_ID % 7 = 0 or Cell_ID % 11 = 0)").select("position", "frame_i", "Cell_ID", parent.alias("parent_ID"))


@query(f"{_UPDATED}{_FOREST}updated", "lineage")
def lineage_update_frame(spark, d):
    forest = _forest(spark, d)
    return _shown(L.update_frames(forest, _edits(forest)))


@query(f"{_PROPAGATED}{_FOREST}propagated", "lineage")
def lineage_propagate(spark, d):
    forest = _forest(spark, d)
    return _shown(L.propagate(L.update_frames(forest, _edits(forest)), 2, _edits(forest)))


@query("""SELECT position, frame_i, Cell_ID, 1 AS generation_num_tree, -1 AS parent_ID_tree, Cell_ID AS root_ID_tree, FALSE AS is_history_known, '' AS sisters FROM lineage""", "lineage")
def lineage_roots(spark, d):
    return _shown(L.roots(table(spark, d, "lineage").drop("parent_ID_tree")))


@query("""SELECT position, frame_i, Cell_ID, 1 AS a, -1 AS b FROM lineage WHERE frame_i = 3""", "lineage")
def lineage_frame_export(spark, d):
    rows = L.frame_rows(L.roots(table(spark, d, "lineage")), 3)
    return L.flat_sisters(rows, 2).select("position", "frame_i", "Cell_ID", F.col("generation_num_tree").alias("a"), F.col("sister_ID_tree_1").alias("b"))


_INFO = """, i AS (SELECT 'f' || r_regionkey AS filename, t AS frame_i, CASE WHEN t = 2 THEN 1 WHEN t = 7 THEN 12 ELSE 5 END AS z FROM region, (SELECT unnest(range(10)) AS t))"""


def _info(spark, d):
    files = spark.read.parquet(f"{d}/region.parquet").select(F.concat(F.lit("f"), F.col("r_regionkey").cast("string")).alias("filename"))
    info = Z.defaults(files, 10, 11)
    for r in range(5):
        info = Z.edit(Z.edit(info, f"f{r}", 2, 1), f"f{r}", 7, 12)
    return info


@query("""SELECT 'f' || r_regionkey AS filename, t AS frame_i, 5 AS z, 'single z-slice' AS proj FROM region, (SELECT unnest(range(10)) AS t)""", "mask")
def zslice_defaults(spark, d):
    files = spark.read.parquet(f"{d}/region.parquet").select(F.concat(F.lit("f"), F.col("r_regionkey").cast("string")).alias("filename"))
    return Z.defaults(files, 10, 11).select("filename", "frame_i", F.col("z_slice_used_dataPrep").alias("z"), F.col("which_z_proj").alias("proj"))


@query(_INFO + " SELECT filename, frame_i, CASE WHEN filename = 'f1' AND frame_i >= 2 THEN 1 ELSE z END AS z FROM i")
def zslice_fill(spark, d):
    return Z.spread(_info(spark, d), "f1", 2, "forward").select("filename", "frame_i", F.col("z_slice_used_dataPrep").alias("z"))


@query(_INFO + " SELECT filename, frame_i, CASE WHEN filename = 'f1' AND frame_i <= 7 THEN 12 ELSE z END AS z FROM i")
def zslice_fill_backward(spark, d):
    return Z.spread(_info(spark, d), "f1", 7, "backward").select("filename", "frame_i", F.col("z_slice_used_dataPrep").alias("z"))


@query(_INFO + """ SELECT filename, frame_i, CASE WHEN filename = 'f1' AND frame_i = 6 THEN CAST(round((1 - 0.0) * 5) AS BIGINT) WHEN filename = 'f1' AND frame_i = 7 THEN 5 WHEN filename = 'f1' AND frame_i = 8 THEN 5 ELSE z END AS z FROM i""")
def zslice_fill_linear(spark, d):
    return Z.spread(_info(spark, d), "f1", 7, "linear").select("filename", "frame_i", F.col("z_slice_used_dataPrep").alias("z"))


@query(_INFO + " SELECT filename, frame_i, CASE WHEN z >= 11 THEN 5 ELSE z END AS z FROM i")
def zslice_clamp(spark, d):
    return Z.clamp(_info(spark, d), 11).select("filename", "frame_i", F.col("z_slice_used_dataPrep").alias("z"))


@query("""SELECT v.frame_i, y, x, label, value FROM volume v WHERE z = CASE WHEN frame_i = 1 THEN 4 ELSE 3 END""", "volume")
def zslice_join(spark, d):
    files = spark.createDataFrame([("f0",)], "filename string")
    info = Z.edit(Z.defaults(files, 2, 7), "f0", 1, 4)
    return Z.with_slices(table(spark, d, "volume"), info, "f0").select("frame_i", "y", "x", "label", "value")


_OBJECTS = """, p AS (SELECT CAST(substr(position, 10) AS BIGINT) AS place, frame_i, label, y, x FROM scenes WHERE label <> 0), b AS (SELECT place, frame_i, label, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM p GROUP BY ALL)"""
#: The pixels of an object's box that are not its own, and those of them from which the box's edge is reached.
_FREE = f"""{_OBJECTS}, g AS (SELECT place, frame_i, label, y0, y1, x0, x1, y, unnest(range(x0, x1 + 1)) AS x FROM (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM b)),
  f AS (SELECT g.* FROM g ANTI JOIN p ON p.place = g.place AND p.frame_i = g.frame_i AND p.label = g.label AND p.y = g.y AND p.x = g.x),
  walk AS (SELECT place, frame_i, label, y, x FROM f WHERE y IN (y0, y1) OR x IN (x0, x1)
    UNION SELECT f.place, f.frame_i, f.label, f.y, f.x FROM walk w JOIN f ON f.place = w.place AND f.frame_i = w.frame_i AND f.label = w.label AND abs(f.y - w.y) + abs(f.x - w.x) = 1),
  filled AS (SELECT place, frame_i, label, y, x FROM p UNION SELECT place, frame_i, label, y, x FROM g WHERE (place, frame_i, label, y, x) NOT IN (SELECT place, frame_i, label, y, x FROM walk))"""


@query(f"{_FREE} SELECT 'Position_' || place AS position, frame_i, y, x, label FROM filled", "scenes")
def fill_holes(spark, d):
    return N.fill_holes(table(spark, d, "scenes"), ["position", "frame_i"])


@query(f"""{_FREE}, e AS (SELECT place, frame_i, label, y, min(x) AS a, max(x) + 1 AS z FROM p GROUP BY ALL), c AS (SELECT place, frame_i, label, y + unnest([0, 1]) AS y, a, z FROM e),
  k AS (SELECT place, frame_i, label, y, unnest([a, z]) AS x FROM c), d AS (SELECT k.place, k.frame_i, k.label, max((k.y - o.y) ** 2 + (k.x - o.x) ** 2) AS far FROM k JOIN k o USING (place, frame_i, label) GROUP BY ALL)
  SELECT 'Position_' || place AS position, frame_i, label, round(sqrt(far), 6) AS feret_diameter_max, n AS filled_area FROM d JOIN (SELECT place, frame_i, label, count(*) AS n FROM filled GROUP BY ALL) USING (place, frame_i, label)""", "scenes")
def hull_extents(spark, d):
    out = N.hulls(table(spark, d, "scenes"), ["position", "frame_i"])
    return out.select("position", "frame_i", "label", F.round("feret_diameter_max", 6).alias("feret_diameter_max"), "filled_area")


@query()
def hull_metrics(spark, d):
    return N.hulls(table(spark, d, "scenes"), ["position", "frame_i"])


@query()
def shape_postprocess(spark, d):
    return N.keep_shapes(table(spark, d, "scenes"), 20, 0.01, 3.0, ["position", "frame_i"]).select("position", "frame_i", "y", "x", "label")


@query()
def preprocess_chain(spark, d):
    steps = [("gaussian_filter", {"sigma_y": 1.0, "sigma_x": 0.5}), ("remove_hot_pixels", {}), ("spot_detector_filter", {"radius_y": 2.0, "radius_x": 2.0}), ("ridge_filter", {"sigmas": [1.0, 2.0]}), ("enhance_speckles", {"radius": 2}), ("correct_illumination", {"block": 3, "diameter": 4.0})]
    return N.preprocess(mask(spark, d), steps)
