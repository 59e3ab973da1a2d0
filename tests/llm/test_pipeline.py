import corpus_pipeline
import pytest

from wardlake.llm import decontaminate, mixing, near_duplicates, toxicity

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        tables.append(docs)
    return tables


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_in_order_with_the_columns_of_documents(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    for table in stages[1:5]:
        assert table.dtypes == stages[0].dtypes


def test_each_stage_takes_effect_on_its_own_input(spark, stages):
    docs, clean, distinct, safe, mixed, shards = stages
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    assert ids(clean) == ids(toxicity.scores(docs, labels).where("predicted = 0"))
    assert ids(distinct) == ids(near_duplicates.near_duplicates(clean).where("kept"))
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    assert ids(safe) == ids(decontaminate.contamination_report(distinct, bench).where("NOT contaminated"))
    taken = mixing.mix(safe).collect()
    assert ids(mixed) == sorted(r.doc_id for r in taken for _ in range(r.times))
    assert ids(shards) == ids(mixed) and set(shards.columns) - set(docs.columns) == {"shard", "slot"}


def test_empty_documents(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0
