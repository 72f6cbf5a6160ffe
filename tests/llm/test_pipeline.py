import random

import pytest
from corpora import prose

pipeline = pytest.importorskip("corpus_pipeline")
from marketframe.llm import secret_scan  # noqa: E402


@pytest.fixture
def sf_dir(spark, tmp_path):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(240):
        text, toxic = prose(rng, 60), i % 4 == 0
        if toxic:
            text = " ".join([text, *rng.sample(["vileone", "viletwo", "vilethree"], 2), prose(rng, 20)])
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(toxic)))
    item = prose(rng, 30)
    docs += [(1000, docs[1][1], "en", "s", 1), (1001, docs[2][1] + " one more", "en", "s", 1), (1002, prose(rng, 40) + " " + item + " " + prose(rng, 40), "en", "s", 1), (1003, prose(rng, 40) + " password = abcdefgh12345", "en", "s", 1), (1004, None, None, None, None), (None, prose(rng, 30), None, None, None)]
    at = str(tmp_path)
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids, columns = [], docs.columns
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
        if i < 4:
            assert docs.columns == columns, name
        ids.append({r.doc_id for r in docs.select("doc_id").distinct().collect()})
    every = {*range(240), *range(1000, 1005), None}
    toxic = {i for i in range(240) if i % 4 == 0}
    assert ids[0] == every - toxic
    assert ids[1] == ids[0] - {1000, 1001}
    assert ids[2] == ids[1] - {1002}
    assert ids[3] == ids[2] and ids[4] == ids[3]
    masked = spark.read.parquet(f"{tmp_path}/stage3").where("doc_id = 1003").first().text
    assert "[SECRET]" in masked and not secret_scan.base_spans(masked)
    run = pipeline.run(spark, sf_dir)
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, run.select(same).collect())) == sorted(map(str, docs.select(same).collect()))


def test_empty(spark, sf_dir, tmp_path):
    none = str(tmp_path / "none")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{none}/{t}.parquet")
    assert pipeline.run(spark, none).count() == 0
