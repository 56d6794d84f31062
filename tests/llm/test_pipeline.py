"""The pipeline: its stages in order, whole, and their decisions in effect."""

from collections import Counter

import corpus_pipeline
from fathomline.llm import minhash, mixing, packing, quality, repeats
from .test_corpus import ROWS, SCHEMA, check_sequences


def test_run_is_the_stages_one_after_another(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.createDataFrame(ROWS, SCHEMA)
    one = quality.keep(docs).cache()
    two = minhash.keep(one, 5).cache()
    three = repeats.remove(two, corpus_pipeline.PASSAGE, corpus_pipeline.PASSAGE_GRAM).filter("length(text) > 0").cache()
    four = mixing.sample(three).cache()
    want = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.best_fit_packing(four).collect())
    assert one.count() >= two.count() >= three.count() >= four.count() > 0
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    check_sequences(out)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), SCHEMA)
        assert docs.columns == [c.strip("`").split(" ")[0].strip("`") for c in SCHEMA.split(", ")], name


def test_copies_near_copies_and_passages_go(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    one = corpus_pipeline.quality_rules(spark, docs, "")
    ids = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, one, "").collect()}
    kept = {r["doc_id"] for r in one.collect()}
    for group in ((0, 24, 25), (1, 26), (2, 27, 28), (3, 29, 30)):
        assert len(ids & set(group)) <= 1 and (not kept & set(group) or ids & set(group))
