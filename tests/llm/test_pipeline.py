"""The pipeline over a small table against its stages one by one."""

import corpus_pipeline
from boolscope.llm import queries


def test_stages(spark, make_docs, corpus, tmp_path):
    docs = make_docs([*corpus, (500, "word $$$ | ### " * 40)]).select("doc_id", "text", "lang", "source", "n_chars")
    bench = spark.createDataFrame([(1, corpus[8][1])], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {r["doc_id"] for r in at.collect()}
    assert 8 not in ids and 500 not in ids and 0 in ids
    assert 3 in ids and 41 not in ids  # 40 and 41 copy 3: both lose their lines, and of emptied documents the first stays
    texts = {r["doc_id"]: r["text"] for r in at.collect()}
    assert texts[3] == corpus[3][1] and texts.get(40, "") == ""
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in pieces.collect()} == ids


def test_registry():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 13))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
