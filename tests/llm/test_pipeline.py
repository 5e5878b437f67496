"""The pipeline stage by stage, and the registered queries."""

import __spark_entry__ as entry
import corpus_pipeline
from ledgerlight.llm import packing, quality, registry, simhash

DIR = "/root/testdata/sf0.001"


def test_registered():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(registry.ORACLE) <= set(registry.QUERIES)


def test_stages_compose(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").cache()
    kept = corpus_pipeline.quality_stage(spark, docs, DIR)
    scores = quality.query(spark, DIR).where("predicted = 1")
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in scores.select("doc_id").collect()}
    lines = corpus_pipeline.line_stage(spark, docs, DIR)
    assert lines.schema.names == docs.schema.names and lines.count() == docs.count()
    assert lines.where("n_chars <> length(text)").count() == 0
    one = corpus_pipeline.simhash_stage(spark, docs, DIR)
    groups = {r[0] for r in simhash.query(spark, DIR).select("component_id").collect()}
    assert one.columns == docs.columns and sorted(r[0] for r in one.select("doc_id").collect()) == sorted(groups)
    docs.unpersist()


def test_run_packs_what_is_kept(spark):
    got = corpus_pipeline.run(spark, DIR)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = packing.stored(stage(spark, docs, DIR), "test-stage")
    assert {r[0] for r in got.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
    assert got.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def test_stages_on_empty_and_other_tables(spark):
    schema = "doc_id long, text string, _row string, fp string, copy int"
    for rows in ([], [(1, None, "a", "b", 1), (1, "", "a", "b", 1), (None, "one line\none line\n" * 40, "a", "b", 2)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DIR)
            if name == "packing":
                assert out.select("doc_id", "copy").distinct().count() == len(rows)
            else:
                # no n_chars to follow; the columns of the table, clashing names included
                assert out.columns == docs.columns and out.count() <= len(rows)
