"""The stages in a row, and on odd tables."""

import corpus_pipeline
from rowtide.llm import queries


def test_pipeline(spark, table):
    sf_dir = "/root/testdata/sf0.001"
    docs = table("documents")
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf_dir)
        if name != "tokens":
            assert out.columns == docs.columns
        assert out.count() > 0
        assert step(spark, docs.where("false"), sf_dir).count() == 0
    good = {r["doc_id"] for r in queries.good_documents(spark, docs, sf_dir).collect()}
    clean = {r["doc_id"] for r in table("labels").where("quality = 1").collect()}
    assert len(clean - good) <= 1
    assert corpus_pipeline.run(spark, sf_dir).select("token_ids").count() > 0


def test_registered():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert "pipeline" in __spark_entry__.queries()
