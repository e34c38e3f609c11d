"""Lineage changes against plain loops over the rows, one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import lineage as L

CYCLES = "position long, frame_i long, Cell_ID long, relative_ID long, relationship string, generation_num long, _row_id long"
FOREST = "position long, frame_i long, Cell_ID long, Cell_ID_tree long, generation_num_tree long, parent_ID_tree long, root_ID_tree long, is_history_known boolean, sisters array<long>, _row_id long"


def read_forest(df):
    return sorted(tuple(r[c] for c in ("position", "_row_id", "Cell_ID", *L.TREE)) for r in df.collect())


def as_tuples(rows):
    return sorted((r["position"], r["_row_id"], r["Cell_ID"], *(r[c] for c in L.TREE)) for r in rows)


def by_position(rows):
    places = {}
    for r in sorted(rows, key=lambda r: r["_row_id"]):
        places.setdefault(r["position"], []).append(r)
    return places.values()


def loop_from_cycles(rows):
    for place in by_position(rows):
        last = {(r["frame_i"], r["Cell_ID"]): r for r in place}
        for r in place:
            generation = r["generation_num"]
            r.update(Cell_ID_tree=r["Cell_ID"], generation_num_tree=1 if generation is None else generation, parent_ID_tree=-1, root_ID_tree=r["Cell_ID"], is_history_known=False, sisters=[])
        for r in place:
            parent = r["relative_ID"] or -1
            if parent <= 0 or (r["relationship"] or "").lower() == "mother":
                continue
            of = last.get((r["frame_i"], parent)) or next((x for x in place if x["Cell_ID"] == parent), None)
            generation = of["generation_num_tree"] + 1 if of else max(2, r["generation_num"] or 2)
            r.update(parent_ID_tree=parent, generation_num_tree=generation, root_ID_tree=of["root_ID_tree"] if of else parent, is_history_known=True)
        for frame, parent in sorted({(r["frame_i"], r["parent_ID_tree"]) for r in place if r["parent_ID_tree"] > 0}):
            ids = sorted({r["Cell_ID"] for r in place if (r["frame_i"], r["parent_ID_tree"]) == (frame, parent)})
            for cell in ids:
                last[frame, cell]["sisters"] = [i for i in ids if i != cell]
    return rows


def loop_regroup(place, cells):
    for cell in cells:
        frames = [r["frame_i"] for r in place if r["Cell_ID"] == cell]
        if not frames:
            continue
        here = [r for r in place if r["frame_i"] == min(frames)]
        own = [r for r in here if r["Cell_ID"] == cell][-1]
        if own["parent_ID_tree"] <= 0:
            own["sisters"] = []
            continue
        family = [r for r in here if r["parent_ID_tree"] == own["parent_ID_tree"]]
        for r in family:
            r["sisters"] = sorted({x["Cell_ID"] for x in family} - {r["Cell_ID"]})


def descend(row, parent):
    row.update(parent_ID_tree=parent["Cell_ID_tree"], generation_num_tree=parent["generation_num_tree"] + 1, root_ID_tree=parent["root_ID_tree"], is_history_known=True)


def loop_update(rows, edits):
    for place in by_position(rows):
        own = {(f, c): p for at, f, c, p in edits if at == place[0]["position"]}
        last = {(r["frame_i"], r["Cell_ID"]): r for r in place}
        for key, parent in own.items():
            last[key]["parent_ID_tree"] = parent
        for f, c in sorted(own):
            r, parent = last[f, c], last.get((f, own[f, c])) if own[f, c] > 0 else None
            if parent:
                descend(r, parent)
            else:
                r.update(parent_ID_tree=-1, generation_num_tree=1, root_ID_tree=c, is_history_known=False, sisters=[])
        loop_regroup(place, sorted({c for _, c in own}))
    return rows


def loop_propagate(rows, frame, cells):
    for place in by_position(rows):
        last = {(r["frame_i"], r["Cell_ID"]): r for r in place}
        frames, names, touched = sorted({r["frame_i"] for r in place}), {}, set(cells)
        for c in sorted(c for c in set(cells) if (frame, c) in last):
            names[c] = {c} | {last[f, c]["Cell_ID_tree"] for f in frames if f >= frame and (f, c) in last}
        for c in names:
            for f in frames:
                if f > frame and (f, c) in last:
                    last[f, c].update({k: last[frame, c][k] for k in L.TREE})
        for c in sorted(names):
            for f in frames:
                if f > frame and (f, c) in last:
                    for r in place:
                        if r["frame_i"] == f and r["Cell_ID"] != c and r["parent_ID_tree"] in names[c] | {last[f, c]["Cell_ID_tree"]}:
                            descend(r, last[f, c])
                            touched.add(r["Cell_ID"])
        loop_regroup(place, sorted(touched))
    return rows


def cycles(seed, n, cells=25, twice=True):
    r, rows = random.Random(seed), {}
    for i in range(n):
        place, frame, cell = r.randrange(3), r.randrange(4), r.randrange(1, cells)
        key = (place, frame, cell, i if twice and r.random() < 0.1 else 0)
        rows[key] = (place, frame, cell, r.choice([None, -1, 0, *range(1, cells + 3)]), r.choice(["bud", "Mother", None, "", "bud"]), r.choice([None, 0, 1, 4]))
    rows = list(rows.values())
    r.shuffle(rows)
    return [(*row, i * 7) for i, row in enumerate(rows)]


def dicts(rows, shape):
    return [dict(zip((c.split()[0] for c in shape.split(", ")), x)) for x in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_from_cycles(spark, seed):
    rows = cycles(seed, 200)
    assert read_forest(L.from_cycles(spark.createDataFrame(rows, CYCLES).repartition(3))) == as_tuples(loop_from_cycles(dicts(rows, CYCLES)))


def test_a_long_chain_takes_few_rounds(spark):
    rows = [(0, 0, c, c - 1, "bud", 1, c) for c in range(1, 300)]
    got = {x[2]: (x[4], x[6]) for x in read_forest(L.from_cycles(spark.createDataFrame(rows, CYCLES)))}
    assert got == {c: (c, 1) for c in range(1, 300)}


def forest(seed, n):
    r = random.Random(seed)
    made = {(x[0], x[1], x[2]): x for x in cycles(seed, n, 15, twice=False)}
    rows = loop_from_cycles(dicts(made.values(), CYCLES))
    for x in rows:
        x["Cell_ID_tree"] = r.choice([x["Cell_ID"]] * 3 + [x["Cell_ID"] % 4 + 1, x["Cell_ID"] + 100])
    return rows


def frame_of(spark, rows):
    names = [c.split()[0] for c in FOREST.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], FOREST).repartition(3)


@pytest.mark.parametrize("seed", [3, 4])
def test_update_frames(spark, seed):
    rows, r = forest(seed, 150), random.Random(seed)
    edits = sorted({(x["position"], x["frame_i"], x["Cell_ID"]): (x["position"], x["frame_i"], x["Cell_ID"], r.choice([-1, x["Cell_ID"], *range(1, 18)])) for x in rows if r.random() < 0.4}.values())
    got = L.update_frames(frame_of(spark, rows), spark.createDataFrame(edits, "position long, frame_i long, Cell_ID long, parent_ID long"))
    assert read_forest(got) == as_tuples(loop_update(rows, edits))


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_propagate(spark, seed):
    rows, cells = forest(seed, 150), [1, 2, 3, 5, 8, 13, 99]
    got = L.propagate(frame_of(spark, rows), 1, cells)
    assert read_forest(got) == as_tuples(loop_propagate(rows, 1, cells))


def test_an_edit_of_a_cell_that_is_not_there(spark):
    df = frame_of(spark, forest(8, 20))
    with pytest.raises(ValueError, match="not in frame"):
        L.update_frame(df, 0, {999: 1})
    assert read_forest(L.update_frame(df, 0, {})) == read_forest(df)


def test_no_rows(spark):
    assert L.from_cycles(spark.createDataFrame([], CYCLES)).count() == 0
    none = spark.createDataFrame([], FOREST)
    assert L.propagate(none, 0, [1]).count() == 0 and L.update_frames(none, none.select("position", "frame_i", "Cell_ID", F.lit(1).alias("parent_ID"))).count() == 0
