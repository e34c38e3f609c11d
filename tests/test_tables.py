"""Object-table operators: tables drawn at random against plain loops, and a few written out."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cellweave.functions.formula import FormulaError, parse
from cellweave.operators import annotations as A
from cellweave.operators import combine as C
from cellweave.operators import phases as P
from cellweave.operators import relatives as R

DRAWN = "position string, frame_i long, Cell_ID long, relative_ID long, cell_cycle_stage string, relationship string, generation_num long, will_divide long, cell_vol_fl double, mch_raw_sum double"


def table(spark, shape, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{shape}, _row_id long")


def rows(df, *names):
    return [tuple(r) for r in df.orderBy("_row_id").select(*names).collect()]


def drawn(seed, n=120):
    """Rows of a few cells in two places, repeated ones among them, in any order."""
    r = random.Random(seed)
    return [
        (r.choice(["left", "right"]), r.randrange(6), r.randrange(1, 7), r.choice([-1, *range(1, 8)]), r.choice(["G1", "S", "S", ""]), r.choice(["mother", "bud"]), r.randrange(4), r.choice([0, 0, 1, None]), float(r.randrange(1, 90)), r.choice([None, float(r.randrange(500))]))
        for _ in range(n)
    ]


def dicts(data):
    return [dict(zip((c.split()[0] for c in DRAWN.split(", ")), x)) for x in data]


def alike(got, want):
    """Equal, where NaN equals NaN."""
    return len(got) == len(want) and all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)) for a, b in zip(got, want) for x, y in zip(a, b))


@pytest.mark.parametrize("seed", [1, 2])
def test_relatives(spark, seed):
    data = dicts(drawn(seed))
    want = []
    for r in data:
        rel = next((o for o in data if (o["position"], o["frame_i"], o["Cell_ID"]) == (r["position"], r["frame_i"], r["relative_ID"])), None)
        number = lambda v: math.nan if v is None else v
        both = lambda c: number(r[c]) + number(rel and rel[c]) if r["cell_cycle_stage"] == "S" else r[c]  # noqa: B023, E731
        want.append((both("mch_raw_sum"), both("cell_vol_fl"), rel and rel["cell_vol_fl"], rel and rel["generation_num"]))
    out = R.relatives_data(table(spark, DRAWN, drawn(seed)), ["mch"])
    assert alike(rows(out, "mch_combined_raw_sum_mother_bud", "combined_mother_bud_volume", "cell_vol_fl_rel", "generation_num_rel"), want)


@pytest.mark.parametrize("seed", [3, 4])
def test_generation_of_relative(spark, seed):
    data = dicts(drawn(seed))
    want = []
    for r in data:
        here = [o for o in data if (o["position"], o["frame_i"]) == (r["position"], r["frame_i"]) and o["Cell_ID"] == r["relative_ID"]]
        back = [o for o in here if o["relative_ID"] == r["Cell_ID"]]
        want.append(((back or here)[-1]["generation_num"] if here else -1,))
    assert rows(R.generation_of_relative(table(spark, DRAWN, drawn(seed)), ["position"]), "generation_num_relID") == want


def test_phases_and_cycles(spark):
    shape = "frame_i long, Cell_ID long, generation_num long, position string, file string, max_frame_pos long, cell_cycle_stage string, cell_area_um2 double, cell_vol_fl double, cell_area_um2_rel double, cell_vol_fl_rel double, combined_mother_bud_volume double, " + ", ".join(f"mch_{m} double" for m in ("corrected_amount", "corrected_mean", "corrected_concentration", "combined_amount_mother_bud"))
    frames = {("G1", 7, 1): range(4, 7), ("S", 7, 1): range(7, 12), ("G1", 7, 2): range(12, 15), ("S", 8, 0): range(0, 3)}
    value = lambda f, k: float((f * f + 3 * k) % 23)
    t = table(spark, shape, [(f, cell, gen, "left", "a.tif", 14, stage, *(value(f, k) for k in range(9))) for (stage, cell, gen), fs in frames.items() for f in reversed(fs)])
    got = {(x.cell_cycle_stage, x.Cell_ID, x.generation_num): x for x in P.phase_quantities(t, ["max_frame_pos", "Cell_ID", "generation_num", "position", "file", "cell_cycle_stage"], ["mch", "none"]).collect()}
    assert set(got) == set(frames)
    for k, fs in frames.items():
        x, a, z = got[k], fs[0], fs[-1]
        assert (x.phase_begin, x.phase_end, x.phase_length) == (a, z, z - a)
        assert (x.phase_area_growth, x.phase_volume_growth, x.phase_daughter_volume_growth) == (value(z, 0) - value(a, 0), value(z, 1) - value(a, 1), value(z, 3) - value(a, 3))
        assert (x.phase_volume_at_end, x.phase_combined_volume_at_end, x.phase_mch_amount_at_beginning, x.phase_mch_concentration_at_end, x.phase_mch_combined_amount_at_end) == (value(z, 1), value(z, 4), value(a, 5), value(z, 7), value(z, 8))
        assert x.complete_phase == int(a > 0 and z < 14) and x.complete_cycle == int(k[1:] == (7, 1))


@pytest.mark.parametrize("seed", [5, 6])
def test_cycles_that_divide_and_end(spark, seed):
    data = dicts(drawn(seed))
    cycle = lambda r: (r["position"], r["Cell_ID"], r["generation_num"])
    divides = {cycle(r) for r in data if (r["will_divide"] or 0) > 0}
    ends = {k: max((r["frame_i"] for r in data if cycle(r) == k and r["cell_cycle_stage"] == "S"), default=-1) for k in divides}
    want = [(1.0 if cycle(r) in divides else r["will_divide"], ends.get(cycle(r), -1)) for r in data]
    assert rows(P.derived_cycle_columns(table(spark, DRAWN, drawn(seed)), ["position"]), "will_divide", "end_of_cell_cycle_frame_i") == want


@pytest.mark.parametrize("seed", [7, 8])
def test_cells_that_do_not_go_on_do_not_divide(spark, seed):
    data = dicts(drawn(seed))
    staged = {(r["position"], r["Cell_ID"], r["generation_num"]) for r in data if r["cell_cycle_stage"]}
    divides = {(r["position"], r["Cell_ID"], r["generation_num"]) for r in data if r["cell_cycle_stage"] and (r["will_divide"] or 0) > 0}
    want = []
    for r in data:
        p, c, g = r["position"], r["Cell_ID"], r["generation_num"]
        want.append((0 if r["cell_cycle_stage"] and (p, c, g) in divides and (p, c, g + 1) not in staged else r["will_divide"],))
    assert rows(A.fix_will_divide(table(spark, DRAWN, drawn(seed))), "will_divide") == want


def test_buds_that_become_cells_divide_with_their_mothers(spark):
    shape = "position string, frame_i long, Cell_ID long, cell_cycle_stage string, generation_num long, relative_ID long, relationship string"
    data = [
        ("left", 5, 30, "S", 4, 31, "mother"), ("left", 5, 31, "S", 0, 30, "bud"), ("left", 6, 30, "S", 4, 31, "mother"), ("left", 6, 31, "S", 0, 30, "bud"),
        ("left", 7, 30, "G1", 5, -1, "mother"), ("left", 7, 31, "G1", 1, -1, "mother"), ("left", 7, 40, "S", 0, 30, "bud"),
        ("right", 5, 31, "S", 0, 30, "bud"), ("right", 5, 30, "S", 4, 31, "mother"), ("right", 6, 50, "", 0, -1, "mother"),
    ]
    assert [x[0] for x in rows(A.add_will_divide(table(spark, shape, data)), "will_divide")] == [1, 1, 1, 1, 0, 0, 0, 0, 0, None]
    orphan = [("left", 5, 31, "S", 0, 30, "bud"), ("left", 6, 31, "G1", 1, -1, "mother")]
    with pytest.raises(Exception, match="30 is missing at frame 5"):
        A.add_will_divide(table(spark, shape, orphan)).collect()


@pytest.mark.parametrize("seed", [9, 10])
def test_corrected_blocks(spark, seed):
    r = random.Random(seed)
    data = [(p, f, c, r.choice([0, 0, 1, 1, 2])) for p in ("left", "right") for c in (3, 4, 5) for f in range(9) if r.random() < 0.8]
    r.shuffle(data)
    first = {}
    for p, c in {(x[0], x[2]) for x in data}:
        before, begin = None, None
        for f, v in sorted((x[1], x[3]) for x in data if (x[0], x[2]) == (p, c)):
            before, begin = v, (begin if v == before else f)
            first[p, f, c] = begin if v > 0 else -1
    t = table(spark, "position string, frame_i long, Cell_ID long, corrected_assignment long", data)
    out = A.corrected_blocks(t)
    assert rows(out, "corrected_on_frame_i") == [(first[x[:3]],) for x in data] and "corrected_assignment" not in out.columns
    assert set(rows(A.corrected_blocks(t.withColumn("corrected_on_frame_i", F.lit(6))), "corrected_on_frame_i")) == {(6,)}


def test_missing_columns_get_defaults_up_to_the_last_stage(spark):
    t = table(spark, "position string, frame_i long, Cell_ID long, cell_cycle_stage string", [("left", 0, 9, None), ("left", 1, 9, "S"), ("left", 2, 9, ""), ("right", 0, 9, "")])
    names = ("relationship", "generation_num", "emerg_frame_i", "is_history_known", "is_cell_excluded", "is_cell_dead")
    assert rows(A.add_missing_columns(t), *names) == [("mother", 2, -1, False, 0, 0)] * 2 + [(None, None, None, None, 0, 0)] * 2
    plain = table(spark, "frame_i long, Cell_ID long", [(0, 1)])
    assert A.add_missing_columns(plain, []).columns == ["frame_i", "Cell_ID", "_row_id", "is_cell_excluded", "is_cell_dead"]


def test_a_former_table_becomes_one_of_today(spark):
    shape = "index long, position string, frame_i long, Cell_ID long, cell_cycle_stage string, generation_num long, relative_ID long, relationship string, corrected_assignment long"
    data = [
        (0, "left", 3, 20, "S", 6, 21, "mother", 0), (0, "left", 3, 21, "S", 0, 20, "bud", 4), (0, "left", 4, 20, "G1", 7, -1, "mother", 5), (0, "left", 4, 21, "G1", 1, -1, "mother", 4),
        (0, "left", 4, 21, "S", 8, 20, "bud", 0), (0, "left", 5, 21, "S", 1, 22, "mother", 0),
    ]
    out = A.ensure_compatible(table(spark, shape, data[::-1]))
    got = {(x.frame_i, x.Cell_ID): x for x in out.collect()}
    assert len(got) == 5 and {"index", "corrected_assignment"}.isdisjoint(out.columns) and got[4, 21].generation_num == 8
    got = {(x.frame_i, x.Cell_ID): x for x in A.ensure_compatible(table(spark, shape, data)).collect()}
    assert got[4, 21].generation_num == 1 and {k: x.will_divide for k, x in got.items()} == {(3, 20): 1, (3, 21): 1, (4, 20): 0, (4, 21): 0, (5, 21): 0}
    assert {k: x.corrected_on_frame_i for k, x in got.items()} == {(3, 20): -1, (3, 21): 3, (4, 20): 4, (4, 21): 3, (5, 21): -1}


def test_formulas(spark):
    a, b = (table(spark, "frame_i long, Cell_ID long, signal double", [(0, 1, v)]) for v in (2.0, 3.0))
    got = C.combine_metrics([a, b], {"s": "table1_signal + table2_signal", "t": "signal_table1 + signal_table2", "bad": "nothing + 1", "worse": "1 +", "z": "table1_signal / 0"}).first()
    assert (got.s, got.t, got.z) == (5.0, 5.0, math.inf) and math.isnan(got.bad) and math.isnan(got.worse)
    lone = C.combine_metrics([a.select("signal", "_row_id"), b.select(F.col("signal").alias("other"), "_row_id")], {"x": "table1_signal * 2"}).collect()
    assert len(lone) == 2 and sorted(x["__row_index"] for x in lone) == [0, 1]
    value = lambda n: F.lit(4.0)
    assert spark.range(1).select(parse("-(a + 2) * 3 - 1 / 2", value)).first()[0] == -18.5
    for wrong in ("(a", "a b", "* 2", "", "2 ^ 3"):
        with pytest.raises(FormulaError):
            parse(wrong, value)


@pytest.mark.parametrize("seed", [11, 12])
def test_totals_of_mothers_and_buds(spark, seed):
    data = dicts(drawn(seed))
    want = []
    for r in data:
        if r["cell_cycle_stage"] == "G1":
            want.append(("G1", r["Cell_ID"], r["cell_vol_fl"]))
        elif r["cell_cycle_stage"] == "S":
            want.append((r["relationship"].title(), r["Cell_ID"], r["cell_vol_fl"]))
            buds = [o for o in data if (o["position"], o["frame_i"], o["relative_ID"], o["cell_cycle_stage"], o["relationship"]) == (r["position"], r["frame_i"], r["Cell_ID"], "S", "bud")]
            if r["relationship"] == "mother" and buds:
                want.append(("Total", r["Cell_ID"], r["cell_vol_fl"] + buds[-1]["cell_vol_fl"]))
    got = R.mother_bud_total(table(spark, DRAWN, drawn(seed)), {"cell_vol_fl": "Sum of both"}, ["position"]).collect()
    assert sorted((x.entity, x.Cell_ID, x.cell_vol_fl) for x in got) == sorted(want)


def test_names_and_edits(spark):
    t = spark.createDataFrame([(1, "S")], ["# of cycles", "Cell cycle stage"])
    assert A.current_names(t).columns == ["generation_num", "cell_cycle_stage"]
    with pytest.raises(ValueError):
        A.current_names(t.withColumn("generation_num", F.lit(1)))
    o = table(spark, "frame_i long, Cell_ID long, cell_cycle_stage string", [(0, 1, "G1")])
    for edit in ((0, 2, "S"), (0, 1, "M")):
        with pytest.raises(Exception):
            A.apply_edits(o, spark.createDataFrame([edit], "frame_i long, Cell_ID long, cell_cycle_stage string")).collect()


def test_what_does_not_fit_together_in_a_frame(spark):
    shape = "position string, frame_i long, Cell_ID long, cell_cycle_stage string, generation_num long, relative_ID long, relationship string"
    data = [
        ("left", 2, 14, "S", 3, 15, "mother"), ("left", 2, 15, "S", 0, 14, "bud"), ("left", 2, 16, "G1", 0, 15, "mother"), ("left", 2, 17, "G1", 2, -1, "bud"),
        ("left", 2, 18, "S", 1, 99, "mother"), ("left", 2, 19, "S", 0, 14, "bud"), ("right", 2, 14, "S", 3, 15, "mother"), ("right", 2, 15, "S", 0, 14, "bud"),
    ]
    found = {x.category: x.ids for x in A.integrity_of_frames(table(spark, shape, data)).collect()}
    assert found == {
        "relatives in G1": [16], "mothers of generation 0": [16], "buds not in S": [17], "buds with a generation other than 0": [17], "relatives not in the frame": [18],
        "mothers with several buds": [14], "relatives that name another": [19],
    }
    assert A.integrity_of_frames(table(spark, shape, data[6:])).count() == 0
    uneven = A.integrity_of_frames(table(spark, shape, data[:2] + data[4:5])).collect()
    assert ("numbers of mothers and buds differ", []) in [(x.category, x.ids) for x in uneven]


def test_natural_order(spark):
    names = ["Position_10", "Position_2", "Position_02", "position_1"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [x[0] for x in df.orderBy(C.natural_key("name"), "name").collect()] == ["position_1", "Position_02", "Position_2", "Position_10"]


def test_objects_with_mothers_are_found_once(spark):
    """Every pass of the repairs joined all of lineitem with itself again."""
    from cellweave.plans.tables import ensure_compat

    out = ensure_compat(spark, "/root/testdata/sf0.001")
    assert "Relation" not in out._jdf.queryExecution().optimizedPlan().toString()
