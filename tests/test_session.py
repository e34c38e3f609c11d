"""What steps leave behind."""

import time

from cellweave.session import checkpointed


def shuffled(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x.rsplit("/", 1)[-1] for x in files.split("\n") if "/shuffle_" in x and x.endswith(".data")}


def test_what_was_shuffled_for_a_checkpoint_goes_with_it(spark):
    before = shuffled(spark)
    rows = checkpointed(spark.range(100_000).repartition(3, "id"))
    for _ in range(40):
        if not shuffled(spark) - before:
            break
        time.sleep(0.25)
    assert not shuffled(spark) - before and rows.count() == 100_000
    kept = spark.range(1000).repartition(3, "id")
    assert kept.count() == kept.count() == 1000
