"""The pipeline: every stage on nasty and empty tables, and the whole against the operators."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docgrid.llm import queries
from docgrid.llm.common import table
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def folder(spark, documents, labels, benchmark, tmp_path_factory):
    """A data folder whose labels are enough to fit."""
    root = str(tmp_path_factory.mktemp("data"))
    spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(500).write.parquet(f"{root}/documents.parquet")
    labels.write.parquet(f"{root}/labels.parquet")
    benchmark.write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages_in_the_stated_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "near dedup", "decontamination", "packing"]


def test_whole_run(spark, folder):
    docs = table(spark, folder, "documents")
    columns, kept = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and 0.5 * kept[0] < kept[-1] < kept[0]
    pieces = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert pieces == {r.doc_id for r in docs.collect()}


def test_near_stage_keeps_the_smallest_of_each_component(spark, documents):
    from docgrid.llm import simhash

    kept = {r.doc_id for r in corpus_pipeline.near_stage(spark, documents, SMALL).collect()}
    assert kept == {r.component_id for r in simhash.simhash_groups(documents).collect()}


def test_near_stage_decides_by_row(spark):
    """Repeated and null doc_ids on different texts: one row of each component stays."""
    texts = [" ".join(f"{name}{k}" for k in range(400)) for name in ("a", "b", "c", "d")]
    near = [x + " more" for x in texts]
    rows = [(5, texts[0]), (5, near[1]), (1, texts[1]), (7, texts[2]), (7, near[2]), (None, texts[3]), (None, near[3]), (None, near[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, docs, SMALL).collect()]
    assert len(kept) == 4 and {(5, texts[0]), (1, texts[1])} < set(kept)
    assert sorted((str(i), t[0]) for i, t in kept) == [("1", "b"), ("5", "a"), ("7", "c"), ("None", "d")]


@pytest.mark.parametrize("k", range(5))
def test_stages_take_nasty_and_empty_tables(spark, folder, nasty, empty, k):
    stage = corpus_pipeline.STAGES[k][1]
    for docs in (nasty, empty):
        out = stage(spark, docs, folder)
        assert out.count() <= docs.count() * (1 if k < 4 else 1000)
        if k < 4:
            assert out.columns == docs.columns
            assert {str(r.doc_id) for r in out.collect()} <= {str(r.doc_id) for r in docs.collect()}


def test_stages_take_any_column_names(spark, folder, documents):
    odd = documents.limit(60).withColumns({"a.b": F.lit(1), "_lost_id": F.lit(2), "key": F.lit(3), "row": F.lit(4), "may": F.lit(5), "lost": F.lit(6), "h": F.lit(7)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, folder).columns == odd.columns
        assert stage(spark, odd, folder).count() <= 60


def test_queries_are_named_by_number():
    assert [int(k[2:].split("_")[0]) for k in queries.QUERIES] == list(range(1, 14))
