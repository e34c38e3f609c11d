import random

import corpus_pipeline as p


def test_stages_on_planted_rows(spark, tmp_path):
    r = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = text(70)
    docs = [(i, text(r.randint(80, 200))) for i in range(60)]
    docs += [(100 + i, docs[i][1]) for i in range(5)]
    long = text(900)
    docs += [(200, long), (201, long.replace(long.split()[450], "changed", 1))]
    docs += [(300, text(60) + " " + passage + " " + text(90)), (301, text(80) + " " + passage + " " + text(60))]
    docs += [(None, "no id here"), (None, "no id here"), (400, None), (401, ""), (60, docs[3][1]), docs[7], docs[7]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))

    kept = p.drop_poor(spark, d, str(tmp_path))
    assert kept.columns == d.columns and kept.count() == d.count()

    near = p.drop_near_copies(spark, kept, str(tmp_path))
    ids = sorted(x.doc_id for x in near.collect() if x.doc_id is not None)
    assert near.columns == d.columns
    assert ids == sorted([*range(60), 200, 300, 301, 400])
    assert near.where("doc_id is null").count() == 1

    cut = p.drop_repeated_passages(spark, near, str(tmp_path))
    texts = {x.doc_id: x for x in cut.collect()}
    assert cut.columns == d.columns and passage in texts[300].text and passage not in texts[301].text
    assert texts[301].n_chars == len(texts[301].text) and texts[5].text == docs[5][1]

    packed = p.run(spark, str(tmp_path))
    assert {x.doc_id for x in packed.collect()} == set(texts)
    assert [name for name, _ in p.STAGES] and p.ORACLE_SQL is None


def frames(spark, folder, rows, labels=()):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], shape).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_one_id_on_two_texts_loses_neither_but_the_copy(spark, tmp_path):
    r = random.Random(5)
    one, other = (" ".join(f"{c}{r.randrange(999)}" for _ in range(120)) for c in "ab")
    for k, rows in enumerate(([(1, one), (5, one), (5, other)], [(5, other), (5, one), (1, one)])):
        docs = frames(spark, str(tmp_path / str(k)), rows)
        got = {(x.doc_id, x.text) for x in p.drop_near_copies(spark, docs, "").collect()}
        assert got == {(1, one), (5, other)}


def test_quality_stage_drops_what_labels_say(spark, tmp_path):
    r = random.Random(6)
    words = ["the", "of", "river", "stone", "walked", "over", "bridge", "evening"]
    rows = [(i, " ".join(r.choice(words) + ("" if i % 3 else "$$$") for _ in range(60))) for i in range(150)]
    docs = frames(spark, str(tmp_path), [*rows, (500, None), (501, "")], [(i, int(i % 3 > 0), 0) for i, _ in rows])
    kept = {x.doc_id for x in p.drop_poor(spark, docs, str(tmp_path)).collect()}
    assert kept - {500, 501} == {i for i, _ in rows if i % 3}


def test_empty_tables(spark, tmp_path):
    docs = frames(spark, str(tmp_path), [])
    for _, stage in p.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs


def test_columns_may_be_called_as_the_stages_call_theirs(spark, tmp_path):
    r = random.Random(9)
    text = [" ".join(f"v{r.randrange(500)}" for _ in range(90)) for _ in range(3)]
    shape = "doc_id long, text string, lang string, source string, n_chars long, __row long, row string, id long, fp long, `component` string, score double, document string, `a.b` int"
    rows = [(i, t, "en", "s", len(t), 7 + i, f"r{i}", -i, 5, "c", 0.5, "d", 3) for i, t in enumerate([*text, text[0]])]
    spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in p.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [*"doc_id text lang source n_chars __row row id fp component score document".split(), "a.b"]
    assert sorted(map(tuple, docs.collect())) == rows[:3]
