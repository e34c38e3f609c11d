"""Queries of the operators on object tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import annotations as A
from cellweave.operators import combine as C
from cellweave.operators.order import numbered
from cellweave.operators import phases as P
from cellweave.operators import relatives as R
from cellweave.plans.adapters import oracle, table
from cellweave.session import checkpointed

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
AT = ("position", "frame_i", "Cell_ID")
PHASE_KEYS = ("max_frame_pos", "Cell_ID", "generation_num", "position", "file", "cell_cycle_stage")


def query(sql: str | None = None, views: tuple[str, ...] = ("objects",)):
    """Registers a function of ``(spark, sf_dir)`` under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = (f, sql and oracle(sql, *views))
        return f

    return add


def objects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "objects")


_RELATIVES = """, r AS (SELECT position, frame_i, Cell_ID, cell_vol_fl, GFP_corrected_amount, GFP_raw_sum FROM objects)
  SELECT o.position, o.frame_i, o.Cell_ID, r.cell_vol_fl AS cell_vol_fl_rel, r.GFP_raw_sum AS GFP_raw_sum_rel,
    CASE WHEN cell_cycle_stage = 'S' THEN o.cell_vol_fl + coalesce(r.cell_vol_fl, 'nan'::DOUBLE) ELSE o.cell_vol_fl END AS combined_mother_bud_volume,
    CASE WHEN cell_cycle_stage = 'S' THEN o.GFP_corrected_amount + coalesce(r.GFP_corrected_amount, 'nan'::DOUBLE) ELSE o.GFP_corrected_amount END AS GFP_combined_amount_mother_bud,
    CASE WHEN cell_cycle_stage = 'S' THEN o.GFP_raw_sum + coalesce(r.GFP_raw_sum, 'nan'::DOUBLE) ELSE o.GFP_raw_sum END AS GFP_combined_raw_sum_mother_bud
  FROM objects o LEFT JOIN r ON r.position = o.position AND r.frame_i = o.frame_i AND r.Cell_ID = o.relative_ID"""


@query(_RELATIVES)
def relatives_join(spark: SparkSession, d: str) -> DataFrame:
    out = R.relatives_data(objects(spark, d), ["GFP"])
    return out.select(*AT, "cell_vol_fl_rel", "GFP_raw_sum_rel", "combined_mother_bud_volume", "GFP_combined_amount_mother_bud", "GFP_combined_raw_sum_mother_bud")


@query(""", r AS (SELECT o.*, r.cell_vol_fl AS cell_vol_fl_rel, r.cell_area_um2 AS cell_area_um2_rel,
    CASE WHEN o.cell_cycle_stage = 'S' THEN o.cell_vol_fl + coalesce(r.cell_vol_fl, 'nan'::DOUBLE) ELSE o.cell_vol_fl END AS combined_mother_bud_volume
    FROM objects o LEFT JOIN objects r ON r.position = o.position AND r.frame_i = o.frame_i AND r.Cell_ID = o.relative_ID),
  f AS (SELECT *, row_number() OVER (PARTITION BY Cell_ID, generation_num, position, cell_cycle_stage ORDER BY frame_i, _row_id) AS up,
    row_number() OVER (PARTITION BY Cell_ID, generation_num, position, cell_cycle_stage ORDER BY frame_i DESC, _row_id DESC) AS down FROM r),
  g AS (SELECT Cell_ID, generation_num, position, cell_cycle_stage, CAST(min(frame_i) AS DOUBLE) AS b, CAST(max(frame_i) AS DOUBLE) AS e,
    max(CASE WHEN up = 1 THEN cell_area_um2 END) AS a1, max(CASE WHEN down = 1 THEN cell_area_um2 END) AS a2, max(CASE WHEN up = 1 THEN cell_vol_fl END) AS v1,
    max(CASE WHEN down = 1 THEN cell_vol_fl END) AS v2, max(CASE WHEN down = 1 THEN combined_mother_bud_volume END) AS c2,
    max(CASE WHEN up = 1 THEN cell_vol_fl_rel END) AS rv1, max(CASE WHEN down = 1 THEN cell_vol_fl_rel END) AS rv2,
    max(CASE WHEN up = 1 THEN cell_area_um2_rel END) AS ra1, max(CASE WHEN down = 1 THEN cell_area_um2_rel END) AS ra2
    FROM f GROUP BY ALL),
  h AS (SELECT *, CASE WHEN b > 0 AND e < 6 THEN 1 ELSE 0 END AS complete_phase FROM g)
  SELECT 6.0::DOUBLE AS max_frame_pos, 'lineitem' AS file, Cell_ID, generation_num, position, cell_cycle_stage, a2 - a1 AS phase_area_growth, v2 - v1 AS phase_volume_growth,
    a1 AS phase_area_at_beginning, v1 AS phase_volume_at_beginning, v2 AS phase_volume_at_end,
    coalesce(ra2, 'nan'::DOUBLE) - coalesce(ra1, 'nan'::DOUBLE) AS phase_daughter_area_growth, coalesce(rv2, 'nan'::DOUBLE) - coalesce(rv1, 'nan'::DOUBLE) AS phase_daughter_volume_growth,
    e - b AS phase_length, b AS phase_begin, e AS phase_end, c2 AS phase_combined_volume_at_end, complete_phase,
    CASE WHEN sum(complete_phase) OVER (PARTITION BY Cell_ID, generation_num, position) = 2 THEN 1 ELSE 0 END AS complete_cycle FROM h""")
def phase_quantities(spark: SparkSession, d: str) -> DataFrame:
    related = R.relatives_data(objects(spark, d), ["GFP"])
    placed = related.withColumns({"max_frame_pos": F.lit(6.0), "file": F.lit("lineitem")})
    return P.phase_quantities(placed, PHASE_KEYS)


@query("""SELECT position, frame_i, Cell_ID, generation_num,
    CASE WHEN max(will_divide) OVER c > 0 THEN 1.0 ELSE will_divide END::DOUBLE AS will_divide,
    CASE WHEN max(will_divide) OVER c > 0 THEN coalesce(max(CASE WHEN cell_cycle_stage = 'S' THEN frame_i END) OVER c, -1) ELSE -1 END AS end_of_cell_cycle_frame_i
  FROM objects WINDOW c AS (PARTITION BY position, Cell_ID, generation_num)""")
def derived_cycle_end(spark: SparkSession, d: str) -> DataFrame:
    return P.derived_cycle_columns(objects(spark, d), ["position"]).select(*AT, "generation_num", "will_divide", "end_of_cell_cycle_frame_i")


@query(""", l AS (SELECT *, row_number() OVER (PARTITION BY position, frame_i, relative_ID ORDER BY _row_id DESC) AS n FROM objects WHERE cell_cycle_stage = 'S' AND relationship = 'bud'),
  parts AS (SELECT *, 'G1' AS entity FROM objects WHERE cell_cycle_stage = 'G1' UNION ALL SELECT *, 'Mother' FROM objects WHERE cell_cycle_stage = 'S' AND relationship = 'mother'
    UNION ALL SELECT *, 'Bud' FROM objects WHERE cell_cycle_stage = 'S' AND relationship = 'bud'
    UNION ALL SELECT m.* REPLACE (m.cell_area_um2 + l.cell_area_um2 AS cell_area_um2), 'Total' FROM objects m JOIN l ON l.n = 1 AND l.position = m.position AND l.frame_i = m.frame_i AND l.relative_ID = m.Cell_ID
      WHERE m.cell_cycle_stage = 'S' AND m.relationship = 'mother')
  SELECT entity, position, frame_i, Cell_ID, cell_area_um2, cell_vol_fl FROM parts""")
def mother_bud_total(spark: SparkSession, d: str) -> DataFrame:
    out = R.mother_bud_total(objects(spark, d), {"cell_area_um2": "sum", "cell_vol_fl": "mean"}, ["position"])
    return out.select("entity", *AT, "cell_area_um2", "cell_vol_fl")


@query(""", l AS (SELECT position, frame_i, Cell_ID, relative_ID, generation_num FROM objects)
  SELECT o.position, o.frame_i, o.Cell_ID, coalesce(b.generation_num, f.generation_num, -1) AS generation_num_relID
  FROM objects o LEFT JOIN l b ON b.position = o.position AND b.frame_i = o.frame_i AND b.Cell_ID = o.relative_ID AND b.relative_ID = o.Cell_ID
  LEFT JOIN l f ON f.position = o.position AND f.frame_i = o.frame_i AND f.Cell_ID = o.relative_ID""")
def generation_of_relative(spark: SparkSession, d: str) -> DataFrame:
    return R.generation_of_relative(objects(spark, d), ["position"]).select(*AT, "generation_num_relID")


@query("""SELECT s.position, s.frame_i, s.Cell_ID, s.relative_ID FROM objects s WHERE s.cell_cycle_stage = 'S'
  AND NOT EXISTS (SELECT 1 FROM objects o WHERE o.position = s.position AND o.frame_i = s.frame_i AND o.Cell_ID = s.relative_ID)""")
def missing_relatives(spark: SparkSession, d: str) -> DataFrame:
    return R.missing_relatives(objects(spark, d), ["position"]).select(*AT, "relative_ID")


@query("""SELECT o.position, o.frame_i, o.Cell_ID, CASE WHEN max(o.will_divide) OVER (PARTITION BY o.position, o.Cell_ID, o.generation_num) > 0
    AND NOT EXISTS (SELECT 1 FROM objects n WHERE n.position = o.position AND n.Cell_ID = o.Cell_ID AND n.generation_num = o.generation_num + 1) THEN 0 ELSE o.will_divide END AS will_divide
  FROM objects o""")
def fix_will_divide(spark: SparkSession, d: str) -> DataFrame:
    return A.fix_will_divide(objects(spark, d)).select(*AT, "will_divide")


def _with_mothers(spark: SparkSession, d: str) -> DataFrame:
    """Objects whose relatives are in the frame, so that every bud's mother is."""
    o = objects(spark, d)
    pair = o.select("position", "frame_i", F.col("Cell_ID").alias("relative_ID"))
    return o.join(pair, ["position", "frame_i", "relative_ID"], "left_semi")


_BUDS = """, p AS (SELECT o.* FROM objects o SEMI JOIN objects r ON r.position = o.position AND r.frame_i = o.frame_i AND r.Cell_ID = o.relative_ID),
  c AS (SELECT position, Cell_ID, arg_min(relative_ID, _row_id) AS m, min(frame_i) AS f FROM p WHERE relationship = 'bud' GROUP BY 1, 2
    HAVING max(generation_num) > 0),
  y AS (SELECT DISTINCT c.position, p.Cell_ID, p.generation_num FROM c JOIN p ON p.position = c.position AND p.Cell_ID = c.m AND p.frame_i = c.f)
  SELECT p.position, p.frame_i, p.Cell_ID, CASE WHEN (c.m IS NOT NULL AND p.relationship = 'bud') OR y.Cell_ID IS NOT NULL THEN 1 ELSE 0 END AS will_divide
  FROM p LEFT JOIN c ON c.position = p.position AND c.Cell_ID = p.Cell_ID LEFT JOIN y ON y.position = p.position AND y.Cell_ID = p.Cell_ID AND y.generation_num = p.generation_num"""


@query(_BUDS)
def will_divide_from_buds(spark: SparkSession, d: str) -> DataFrame:
    return A.add_will_divide(_with_mothers(spark, d).drop("will_divide")).select(*AT, "will_divide")


@query(""", l AS (SELECT *, lag(corrected_assignment) OVER (PARTITION BY position, Cell_ID ORDER BY frame_i, _row_id) AS before FROM objects),
  b AS (SELECT *, sum(CASE WHEN before <> corrected_assignment THEN 1 ELSE 0 END) OVER (PARTITION BY position, Cell_ID ORDER BY frame_i, _row_id) AS run FROM l)
  SELECT position, frame_i, Cell_ID, CASE WHEN corrected_assignment > 0 THEN min(frame_i) OVER (PARTITION BY position, Cell_ID, run) ELSE -1 END AS corrected_on_frame_i FROM b""")
def corrected_blocks(spark: SparkSession, d: str) -> DataFrame:
    return A.corrected_blocks(objects(spark, d)).select(*AT, "corrected_on_frame_i")


@query(""", s AS (SELECT *, CASE WHEN frame_i < 4 THEN cell_cycle_stage END AS st FROM objects),
  l AS (SELECT position, max(CASE WHEN st IS NOT NULL THEN _row_id END) AS last FROM s GROUP BY 1)
  SELECT s.position, s.frame_i, s.Cell_ID, 0 AS is_cell_dead, CASE WHEN _row_id <= last THEN 2 ELSE -9 END AS generation_num, CASE WHEN _row_id <= last THEN 'mother' END AS relationship,
    CASE WHEN _row_id <= last THEN FALSE END AS is_history_known FROM s JOIN l USING (position)""")
def add_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    stage = F.when(F.col("frame_i") < 4, F.col("cell_cycle_stage"))
    o = objects(spark, d).withColumn("cell_cycle_stage", stage).drop("generation_num", "relationship")
    filled = F.coalesce("generation_num", F.lit(-9)).alias("generation_num")
    return A.add_missing_columns(o).select(*AT, "is_cell_dead", filled, "relationship", "is_history_known")


@query(_BUDS.replace("SELECT p.position, p.frame_i", "SELECT p.*").replace(", p.Cell_ID, CASE", ", CASE") .replace("SELECT p.*, CASE WHEN (c.m", ", w AS (SELECT p.* EXCLUDE (will_divide), CASE WHEN (c.m") + """),
  x AS (SELECT *, max(will_divide) OVER (PARTITION BY position, Cell_ID, generation_num) AS any_divides, lag(corrected_assignment) OVER (PARTITION BY position, Cell_ID ORDER BY frame_i) AS before FROM w),
  z AS (SELECT *, sum(CASE WHEN before <> corrected_assignment THEN 1 ELSE 0 END) OVER (PARTITION BY position, Cell_ID ORDER BY frame_i) AS run FROM x)
  SELECT z.position, z.frame_i, z.Cell_ID, CASE WHEN any_divides > 0 AND NOT EXISTS (SELECT 1 FROM w n WHERE n.position = z.position AND n.Cell_ID = z.Cell_ID AND n.generation_num = z.generation_num + 1)
      THEN 0 ELSE z.will_divide END AS will_divide,
    CASE WHEN corrected_assignment > 0 THEN min(frame_i) OVER (PARTITION BY position, Cell_ID, run) ELSE -1 END AS corrected_on_frame_i, 0 AS is_cell_excluded FROM z""")
def ensure_compat(spark: SparkSession, d: str) -> DataFrame:
    # A small part of the objects has its relative in the frame: found once, not for every pass over the table.
    old = checkpointed(_with_mothers(spark, d).drop("will_divide", "cell_vol_fl", "cell_area_um2", "GFP_corrected_amount", "GFP_raw_sum")).withColumn("index", F.lit(9))
    twice = old.unionByName(old.where("frame_i = 2").withColumns({"_row_id": F.col("_row_id") + 10**9, "generation_num": F.lit(7).cast("long")}))
    return A.ensure_compatible(twice).select(*AT, "will_divide", "corrected_on_frame_i", "is_cell_excluded")


@query("""SELECT position, frame_i, Cell_ID, cell_cycle_stage, generation_num, relationship FROM objects""")
def current_column_names(spark: SparkSession, d: str) -> DataFrame:
    former = {"cell_cycle_stage": "Cell cycle stage", "generation_num": "# of cycles", "relationship": "Relationship"}
    return A.current_names(objects(spark, d).withColumnsRenamed(former)).select(*AT, "cell_cycle_stage", "generation_num", "relationship")


@query(""", b AS (SELECT * FROM objects WHERE relationship = 'bud'), s AS (SELECT * FROM objects WHERE cell_cycle_stage = 'S'),
  i AS (SELECT position, frame_i, Cell_ID AS id, 'buds not in S' AS category FROM b WHERE cell_cycle_stage <> 'S'
    UNION ALL SELECT position, frame_i, Cell_ID, 'buds with a generation other than 0' FROM b WHERE generation_num <> 0
    UNION ALL SELECT position, frame_i, Cell_ID, 'relatives in G1' FROM objects WHERE cell_cycle_stage = 'G1' AND relative_ID > 0
    UNION ALL SELECT position, frame_i, Cell_ID, 'mothers of generation 0' FROM objects WHERE relationship = 'mother' AND generation_num < 1
    UNION ALL SELECT position, frame_i, relative_ID, 'mothers with several buds' FROM b GROUP BY 1, 2, 3 HAVING count(*) > 1
    UNION ALL SELECT s.position, s.frame_i, s.Cell_ID, 'relatives not in the frame' FROM s ANTI JOIN objects r ON r.position = s.position AND r.frame_i = s.frame_i AND r.Cell_ID = s.relative_ID
    UNION ALL SELECT s.position, s.frame_i, s.Cell_ID, 'relatives that name another' FROM s JOIN objects r ON r.position = s.position AND r.frame_i = s.frame_i AND r.Cell_ID = s.relative_ID WHERE r.relative_ID <> s.Cell_ID)
  SELECT position, frame_i, category, array_to_string(list_sort(list_distinct(list(id))), ',') AS ids FROM i GROUP BY 1, 2, 3
  UNION ALL SELECT position, frame_i, 'numbers of mothers and buds differ', '' FROM s GROUP BY 1, 2 HAVING count(*) FILTER (relationship = 'bud') <> count(*) FILTER (relationship = 'mother')""")
def integrity_frame(spark: SparkSession, d: str) -> DataFrame:
    found = A.integrity_of_frames(objects(spark, d))
    return found.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("""SELECT position, 'cycles without G1' AS category, Cell_ID, generation_num FROM objects WHERE generation_num > 0 GROUP BY 1, 3, 4 HAVING NOT bool_or(cell_cycle_stage = 'G1')
  UNION ALL SELECT DISTINCT o.position, 'will_divide without next generation', o.Cell_ID, o.generation_num FROM objects o
    WHERE will_divide > 0 AND NOT EXISTS (SELECT 1 FROM objects n WHERE n.position = o.position AND n.Cell_ID = o.Cell_ID AND n.generation_num = o.generation_num + 1)""")
def integrity_global(spark: SparkSession, d: str) -> DataFrame:
    return A.integrity_of_cycles(objects(spark, d))


@query("""SELECT position, frame_i, Cell_ID, cell_cycle_stage, generation_num, relative_ID, relationship, will_divide <> 0 AS is_history_known FROM objects WHERE Cell_ID % 11 = 3""")
def cycle_fields(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d).withColumn("is_history_known", F.col("will_divide"))
    return A.cycle_fields(o, o.where("Cell_ID % 11 = 3"))


@query("""SELECT position, frame_i, Cell_ID, CASE WHEN position = 1 AND frame_i = 3 THEN 'S' ELSE cell_cycle_stage END AS cell_cycle_stage,
    CASE WHEN position = 1 AND frame_i = 3 THEN 9 ELSE generation_num END AS generation_num FROM objects""")
def point_edits(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    edits = o.where("position = 1 and frame_i = 3").select(*AT, F.lit("S").alias("cell_cycle_stage"), F.lit(9).alias("generation_num"))
    return A.apply_edits(o, edits, AT).select(*AT, "cell_cycle_stage", "generation_num")


@query(""", e AS (SELECT position, Cell_ID, min(frame_i) AS f FROM objects WHERE Cell_ID % 3 = 0 AND frame_i >= 2 GROUP BY 1, 2)
  SELECT o.position, o.frame_i, o.Cell_ID, CASE WHEN o.frame_i >= e.f AND (o.frame_i <= 5 OR o.frame_i = e.f) THEN 'edited' ELSE relationship END AS relationship FROM objects o LEFT JOIN e ON e.position = o.position AND e.Cell_ID = o.Cell_ID""")
def propagate_edits(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    edits = o.where("Cell_ID % 3 = 0 and frame_i >= 2").groupBy("position", "Cell_ID").agg(F.min("frame_i").alias("frame_i")).withColumn("relationship", F.lit("edited"))
    return A.propagate_edits(o, edits, ["position", "Cell_ID"], end_frame=5).select(*AT, "relationship")


@query("""SELECT position, frame_i, Cell_ID, CASE WHEN frame_i = 1 AND Cell_ID = 1 THEN 'mother' WHEN frame_i = 1 AND Cell_ID = 2 THEN 'bud' ELSE relationship END AS relationship,
    CASE WHEN frame_i = 1 AND Cell_ID IN (1, 2) THEN 'S' ELSE cell_cycle_stage END AS cell_cycle_stage, CASE WHEN frame_i = 1 AND Cell_ID = 2 THEN 0 ELSE generation_num END AS generation_num,
    CASE WHEN frame_i = 1 AND Cell_ID = 1 THEN 2 WHEN frame_i = 1 AND Cell_ID = 2 THEN 1 ELSE relative_ID END AS relative_ID FROM
    (SELECT * FROM objects UNION ALL SELECT -1, 1, i, 0, 'none', 'G1', 5, 0, 0, 0, 0, 0, 0, i FROM (VALUES (1), (2)) v(i)) WHERE position = -1 OR (frame_i <> 1)""")
def assign_mother_bud(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d).where("frame_i <> 1")
    lone = o.limit(1).withColumns({"position": F.lit(-1).cast("long"), "frame_i": F.lit(1).cast("long"), "relative_ID": F.lit(0).cast("long"), "relationship": F.lit("none"), "cell_cycle_stage": F.lit("G1"), "generation_num": F.lit(5).cast("long")})
    two = lone.withColumn("Cell_ID", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    return A.assign_mother_bud(o.unionByName(two), 1, 2, 1).select(*AT, "relationship", "cell_cycle_stage", "generation_num", "relative_ID")


@query("""SELECT o.position, o.frame_i, CASE WHEN o.frame_i = 2 AND o.Cell_ID = 7 THEN 8 ELSE o.Cell_ID END AS Cell_ID FROM objects o
  WHERE NOT (o.frame_i = 2 AND o.Cell_ID = 7 AND EXISTS (SELECT 1 FROM objects t WHERE t.position = o.position AND t.frame_i = 2 AND t.Cell_ID = 8))""")
def manual_tracking_edit(spark: SparkSession, d: str) -> DataFrame:
    return A.manual_tracking_edit(objects(spark, d), 2, 7, 8, ["position"]).select(*AT)


@query("""SELECT position, 'will_divide' AS name, frame_i, Cell_ID FROM objects WHERE will_divide <> 0 UNION ALL SELECT position, 'generation_num', frame_i, Cell_ID FROM objects WHERE generation_num <> 0""")
def annotation_memberships(spark: SparkSession, d: str) -> DataFrame:
    return A.memberships(objects(spark, d), ["will_divide", "generation_num"])


@query("""SELECT position, frame_i, Cell_ID, CAST((will_divide <> 0) <> (frame_i = 3) AS INTEGER) AS flag FROM objects""")
def annotation_toggle_and_write(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    members = A.memberships(o, ["will_divide"]).withColumn("name", F.lit("flag"))
    changes = o.where("frame_i = 3").select("position", F.lit("flag").alias("name"), "frame_i", "Cell_ID")
    return A.write_flags(o, A.toggled(members, changes), ["flag"]).select(*AT, "flag")


@query("""SELECT position, frame_i, Cell_ID FROM (SELECT *, row_number() OVER (PARTITION BY position, Cell_ID ORDER BY _row_id) AS n FROM objects) WHERE n = 1""")
def first_rows_by_key(spark: SparkSession, d: str) -> DataFrame:
    return A.first_of_keys(objects(spark, d), ["position", "Cell_ID"]).select(*AT)


_TWO = """, a AS (SELECT frame_i, Cell_ID, min(cell_vol_fl) AS v FROM objects WHERE position % 2 = 0 GROUP BY 1, 2), b AS (SELECT frame_i, Cell_ID, min(cell_area_um2) AS w FROM objects WHERE position % 2 <> 0 GROUP BY 1, 2)"""


def _two(spark: SparkSession, d: str) -> list[DataFrame]:
    """The objects of even positions as one table and those of odd ones as the other."""
    o = objects(spark, d)
    return [o.where(p).groupBy("frame_i", "Cell_ID").agg(F.min(c).alias("signal"), F.min("_row_id").alias("_row_id")) for p, c in (("position % 2 = 0", "cell_vol_fl"), ("position % 2 <> 0", "cell_area_um2"))]


@query(_TWO + """ SELECT coalesce(a.frame_i, b.frame_i) AS frame_i, coalesce(a.Cell_ID, b.Cell_ID) AS Cell_ID, coalesce(v, 'nan'::DOUBLE) + coalesce(w, 'nan'::DOUBLE) AS both_signals,
    coalesce(v, 'nan'::DOUBLE) * 2 - 1 AS twice FROM a FULL JOIN b ON a.frame_i = b.frame_i AND a.Cell_ID = b.Cell_ID""")
def combine_metrics_outer(spark: SparkSession, d: str) -> DataFrame:
    return C.combine_metrics(_two(spark, d), {"both_signals": "table1_signal + table2_signal", "twice": "signal_table1 * 2 - 1"})


@query("""SELECT position, frame_i, Cell_ID, cell_vol_fl, 'Position_' || (position + 1) AS Position_n, 'experiment' AS experiment_foldername FROM objects""")
def concat_positions(spark: SparkSession, d: str) -> DataFrame:
    o = objects(spark, d)
    parts = {f"Position_{p + 1}": o.where(f"position = {p}").drop("cell_area_um2" if p else "GFP_raw_sum") for p in range(4)}
    return C.concat_positions(parts, "experiment").select("position", "frame_i", "Cell_ID", "cell_vol_fl", "Position_n", "experiment_foldername")


@query("""SELECT DISTINCT p_name AS name, CAST(row_number() OVER (ORDER BY regexp_extract(p_name, '^[^0-9]*'), coalesce(try_cast(regexp_extract(p_name, '[0-9]+') AS BIGINT), -1), p_name) AS BIGINT) AS place
  FROM (SELECT DISTINCT 'Position_' || p_size AS p_name FROM part)""", ())
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    names = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("Position_"), F.col("p_size").cast("string")).alias("name")).distinct()
    return numbered(names.withColumn("key", C.natural_key("name")), ["key", "name"], "place").drop("key")
