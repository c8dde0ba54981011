import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from tests.llm.conftest import SF


def test_stages_in_order(spark, documents, tmp_path):
    docs, kept = documents, [documents.count()]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == documents.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] == kept[-2] > 0
    assert kept[1] < kept[0] or documents.filter("text IS NULL OR text = ''").count() == 0
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert packed.count() == pipeline.run(spark, SF).count()


def test_near_copies_and_long_repeats_are_gone(spark, documents):
    docs = documents
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), documents.schema)
    texts = [r["text"].encode() for r in docs.collect() if r["text"]]
    assert len(texts) == len(set(texts))
    # what the last stage left of long strings that two documents shared
    before = [r["text"].encode() for r in documents.collect()]
    seen = set()
    for t in before:
        for a in range(0, max(len(t) - 199, 0), 200):
            seen.add(t[a:a + 200])
    assert sum(len(t) for t in texts) < sum(map(len, before))


def test_odd_rows(spark, odd, empty):
    docs = odd
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), odd.schema)
        assert docs.columns == odd.columns, name
    pipeline.STAGES[-1][1](spark, docs, SF).collect()
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
