"""Object and label tables made of the driver's tables, in SQL that Spark and DuckDB both take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One row per object and frame; orders are cells, odd ones mothers of the even ones that follow.
OBJECTS = """
  SELECT position, frame_i, Cell_ID, relative_ID, relationship, cell_cycle_stage, generation_num, will_divide, corrected_assignment,
    cell_vol_fl, cell_area_um2, GFP_corrected_amount, GFP_raw_sum, frame_i * 100000000000 + Cell_ID * 4 + position AS _row_id
  FROM (SELECT CAST(l_suppkey % 4 AS BIGINT) AS position, CAST(l_linenumber - 1 AS BIGINT) AS frame_i, CAST(l_orderkey AS BIGINT) AS Cell_ID,
    CASE WHEN l_orderkey % 2 = 1 THEN CAST(l_orderkey AS BIGINT) + 1 ELSE CAST(l_orderkey AS BIGINT) - 1 END AS relative_ID,
    CASE WHEN l_orderkey % 2 = 1 THEN 'mother' ELSE 'bud' END AS relationship,
    CASE WHEN l_linestatus = 'O' THEN 'S' ELSE 'G1' END AS cell_cycle_stage,
    CAST(l_quantity AS BIGINT) % 3 AS generation_num, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS will_divide,
    CAST(l_partkey % 3 AS BIGINT) AS corrected_assignment,
    CAST(l_quantity AS DOUBLE) AS cell_vol_fl, CAST(l_extendedprice AS DOUBLE) AS cell_area_um2,
    CAST(l_partkey AS DOUBLE) AS GFP_corrected_amount, CAST(l_suppkey AS DOUBLE) AS GFP_raw_sum,
    ROW_NUMBER() OVER (PARTITION BY l_suppkey % 4, l_linenumber, l_orderkey
                       ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS rn
    FROM {lineitem}) t WHERE rn = 1"""

#: A label image with intensities: 7 frames of 24 by 24, labels 1 to 8, background 0.
MASK = """
  SELECT CAST(l_linenumber - 1 AS BIGINT) AS frame_i, CAST(l_partkey % 24 AS BIGINT) AS y, CAST((l_partkey * 7 + l_suppkey) % 24 AS BIGINT) AS x,
    CASE WHEN MIN(l_orderkey) % 3 = 0 THEN 1 + CAST(FLOOR(MIN(l_orderkey) / 3.0) AS BIGINT) % 8 ELSE 0 END AS label,
    CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS value
  FROM {lineitem} GROUP BY 1, 2, 3"""

#: A volume: 2 frames of 7 by 12 by 12, labels 1 to 6.
VOLUME = """
  SELECT CAST(l_suppkey % 2 AS BIGINT) AS frame_i, CAST(l_linenumber - 1 AS BIGINT) AS z, CAST(l_partkey % 12 AS BIGINT) AS y,
    CAST((l_partkey * 5 + l_suppkey) % 12 AS BIGINT) AS x,
    CASE WHEN MIN(l_orderkey) % 2 = 0 THEN 1 + CAST(FLOOR(MIN(l_orderkey) / 2.0) AS BIGINT) % 6 ELSE 0 END AS label,
    CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS value
  FROM {lineitem} GROUP BY 1, 2, 3, 4"""

#: A lineage table: customers as cells of 5 frames, each the child of one with a smaller id, or a root.
LINEAGE = """
  SELECT CAST(c_nationkey % 3 AS BIGINT) AS position, f AS frame_i, CAST(c_custkey AS BIGINT) AS Cell_ID,
    CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE CAST(FLOOR(c_custkey / 2.0) AS BIGINT) END AS parent_ID_tree,
    f * 100000000000 + CAST(c_custkey AS BIGINT) AS _row_id
  FROM {customer} CROSS JOIN (SELECT CAST(0 AS BIGINT) AS f UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) frames
  WHERE (c_custkey + f * 7) % 6 <> 0"""

#: Label images with intensities, as many positions as orders ask for: 7 frames of 48 by 48, objects in 16 fields.
SCENES = """
  SELECT CONCAT('Position_', CAST(CAST(FLOOR(l_orderkey / 2048.0) AS BIGINT) + 1 AS STRING)) AS position, CAST(l_linenumber - 1 AS BIGINT) AS frame_i,
    CAST(l_partkey % 48 AS BIGINT) AS y, CAST((l_partkey * 7 + l_suppkey) % 48 AS BIGINT) AS x,
    CASE WHEN MIN(l_orderkey) % 4 = 0 THEN 0 ELSE 1 + CAST(FLOOR((l_partkey % 48) / 12.0) * 4 + FLOOR(((l_partkey * 7 + l_suppkey) % 48) / 12.0) AS BIGINT) END AS label,
    CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS value
  FROM {lineitem} GROUP BY 1, 2, 3, 4, l_partkey % 48, (l_partkey * 7 + l_suppkey) % 48"""

#: Volumes of as many positions: 2 frames of 7 by 24 by 24, objects in 4 fields.
STACKS = """
  SELECT CONCAT('Position_', CAST(CAST(FLOOR(l_orderkey / 2048.0) AS BIGINT) + 1 AS STRING)) AS position, CAST(l_suppkey % 2 AS BIGINT) AS frame_i, CAST(l_linenumber - 1 AS BIGINT) AS z,
    CAST(l_partkey % 24 AS BIGINT) AS y, CAST((l_partkey * 5 + l_suppkey) % 24 AS BIGINT) AS x,
    CASE WHEN MIN(l_orderkey) % 3 = 0 THEN 0 ELSE 1 + CAST(FLOOR((l_partkey % 24) / 12.0) * 2 + FLOOR(((l_partkey * 5 + l_suppkey) % 24) / 12.0) AS BIGINT) END AS label,
    CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS value
  FROM {lineitem} GROUP BY 1, 2, 3, 4, 5, l_partkey % 24, (l_partkey * 5 + l_suppkey) % 24"""

#: Three regions of most of these positions, one of every third; some reach over the edges.
ROIS = """
  SELECT CONCAT('Position_', CAST(p + 1 AS STRING)) AS position, r AS roi_id, (p * 5 + r * 13) % 30 - 2 AS top, (p * 3 + r * 17) % 30 - 3 AS `left`,
    (p * 5 + r * 13) % 30 + 6 + r * 9 AS bottom, (p * 3 + r * 17) % 30 + 9 + r * 5 AS `right`
  FROM (SELECT DISTINCT CAST(FLOOR(l_orderkey / 2048.0) AS BIGINT) AS p FROM {lineitem}) places
  CROSS JOIN (SELECT CAST(0 AS BIGINT) AS r UNION ALL SELECT 1 UNION ALL SELECT 2) numbers WHERE r = 0 OR p % 3 <> 0"""

VIEWS = {"objects": OBJECTS, "mask": MASK, "volume": VOLUME, "lineage": LINEAGE, "scenes": SCENES, "stacks": STACKS, "rois": ROIS}


def table(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A domain table over the folder's tables."""
    names = [n for n in ("lineitem", "customer") if f"{{{n}}}" in VIEWS[view]]
    return spark.sql(VIEWS[view], **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def oracle(body: str, *views: str) -> str:
    """A DuckDB query over domain tables."""
    if not views:
        return body
    parts = ", ".join(f"{v} AS ({VIEWS[v].format(lineitem='lineitem', customer='customer').replace('`', chr(34))})" for v in views)
    return f"WITH {parts}{body if body.lstrip().startswith(',') else ' ' + body}"
