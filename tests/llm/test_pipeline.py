"""The stages of the corpus pipeline: each on its own input, decisions against those of the operators."""

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tallyspark.llm import common, packing, quality, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def _ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_classifiers_decide(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score_documents(stages[0], toxicity.fit(stages[0], labels))
    assert _ids(stages[1]) == _ids(scored.where("predicted = 0"))
    good = quality.score_documents(stages[1], quality.fit(stages[1], quality.graded(labels), top=2))
    assert _ids(stages[2]) == _ids(good.where("keep"))


def test_one_of_each_group_stays(stages):
    from .test_operators import _plain_join

    texts = sorted((r["doc_id"], r["text"]) for r in stages[2].collect())
    want = [texts[i][0] for i, _, c in _plain_join([t for _, t in texts]) if i == c]
    assert _ids(stages[3]) == want


def test_secrets_and_packing(stages):
    assert _ids(stages[4]) == _ids(stages[3])
    assert not any("AKIA" in r["text"] and "[SECRET]" not in r["text"] for r in stages[4].where("text rlike 'AKIA[A-Z0-9]{14}'").collect())
    packed = stages[5].collect()
    assert {r["doc_id"] for r in packed} == set(_ids(stages[4]))


def test_run_equals_stages(spark, stages):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages[5].select(*cols).collect()))
    assert pq.read_metadata(f"{SF}/documents.parquet").num_rows >= len({r["doc_id"] for r in got})


def test_driver_gives_memory_back(spark, monkeypatch):
    assert "native heap" in common.release(spark)  # the JVM's own words
    called = []
    monkeypatch.setattr(corpus_pipeline, "release", called.append)
    monkeypatch.setattr(packing, "release", called.append)
    docs = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[2:]:
        before = len(called)
        stage(spark, docs, SF)
        assert len(called) > before + (name == "packing"), name
