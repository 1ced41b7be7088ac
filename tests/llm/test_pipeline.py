import corpus_pipeline
from tiegraph.llm import common, jaccard_join


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf), "test-stage")
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_one_of_each_group_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = jaccard_join.keep_one(docs)
    again = jaccard_join.linked_components(kept, 5, 80)
    assert again.where("component_id <> doc_id").count() == 0
