"""Tracking of pixels that come as they like, against the batch fold."""

import random
from datetime import datetime, timedelta

from cellweave.operators.tracking import track
from cellweave.streaming.tracking import STATE_STORE, track_pixels

SHAPE = "position long, frame_i long, y long, x long, label long, time timestamp"


def scene(seed):
    """Squares that wander, renumbered in every frame, in two positions; a frame a minute."""
    r, rows = random.Random(seed), []
    for position in (1, 2):
        at = {k: (10 * k, 5 * k) for k in range(4)}
        for f in range(5):
            names = r.sample(range(1, 9), 4)
            for k, (y, x) in at.items():
                at[k] = (y + r.randrange(2), x + r.randrange(2))
                if r.random() < 0.9:
                    rows += [(position, f, y + i, x + j, names[k], datetime(2024, 1, 1) + timedelta(minutes=f, seconds=r.randrange(20))) for i in range(4) for j in range(4)]
    return rows


def run(spark, tmp_path, batches, **options):
    spark.conf.set(*STATE_STORE)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(str(tmp_path / f"in/{k:03d}"))
    files = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = track_pixels(files, **options)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    spark.conf.unset(STATE_STORE[0])
    return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]


def test_frames_split_over_batches_equal_the_batch_fold(spark, tmp_path):
    rows = scene(1)
    order = sorted(rows, key=lambda x: x[5])
    mixed = [order[k : k + 97] for k in range(0, len(order), 97)]
    ticks = [(p, 9, 0, 0, 0, datetime(2024, 1, 2)) for p in (1, 2)]
    got = run(spark, tmp_path, [*mixed, ticks], delay="30 seconds")
    want = track(spark.createDataFrame(rows, SHAPE)).collect()
    assert sorted(x[:5] for x in got) == sorted((r.position, r.frame_i, r.y, r.x, r.label) for r in want) and not any(x[5] for x in got)


def test_late_pixels_come_out_marked(spark, tmp_path):
    rows = [x for x in scene(2) if x[0] == 1]
    early, late = [x for x in rows if x[1] != 1], [(*x[:4], 77, x[5]) for x in rows if x[1] == 1][:5]
    got = run(spark, tmp_path, [early, late], delay="1 second")
    assert sorted(x[:5] for x in got if x[5]) == sorted(x[:5] for x in late)
    assert {x[1] for x in got if not x[5]} == {0, 2, 3}
