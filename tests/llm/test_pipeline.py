from collections import Counter

import corpus_pipeline
from llm.test_ngram_join import brute
from pyspark.sql import functions as F

from tablewright.llm import queries
from tablewright.llm.common import stage
from tablewright.llm.mixing import mix
from tablewright.llm.packing import pack
from tablewright.llm.personal_data import LABELLED, find, mask, train
from tablewright.llm.toxicity import toxicity

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage on what its predecessor kept, and `run` on all."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, columns = [docs], docs.columns
    for _, function in corpus_pipeline.STAGES:
        kept.append(stage(function(spark, kept[-1], DATA)))
    assert all(k.columns == columns for k in kept[:-1])
    texts = [{r["doc_id"]: r["text"] for r in k.collect()} for k in kept[:-1]]

    toxic = {r[0] for r in toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet")).filter("predicted = 1").select("doc_id").collect()}
    assert set(texts[1]) == set(texts[0]) - toxic
    of = brute(texts[1].items())
    assert set(texts[2]) == {i for i, (_, c) in of.items() if i == c}
    field, ids = train(list(LABELLED)), sorted(texts[2])
    assert texts[3] == {i: mask(texts[2][i], every) for i, (_, every) in zip(ids, find([texts[2][i] for i in ids], field))}
    assert kept[3].filter(F.char_length("text") != F.col("n_chars")).count() == 0
    times = {r["doc_id"]: r["times"] for r in mix(kept[3]).collect()}
    assert Counter(r["doc_id"] for r in kept[4].collect()) == Counter({i: t for i, t in times.items() if t})
    want = pack(kept[4]).select("doc_id", "piece", "length", "ids_crc32")
    assert sorted(map(str, kept[5].select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, DATA).select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_awkward_documents(spark, awkward, clashing, empty, tmp_path):
    spark.createDataFrame([(1, 0), (5, 1), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (awkward, clashing, empty):
        for _, function in corpus_pipeline.STAGES[:-1]:
            docs = stage(function(spark, docs, str(tmp_path)))
        assert (pack(docs).count() > 0) == (docs.count() > 0)


def test_queries_are_registered():
    import __spark_entry__ as driver

    assert set(queries.QUERIES) | {"pipeline"} <= set(driver.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
