"""The pipeline, stage by stage, on small tables with odd rows."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
import pyarrow as pa
from siftmark.llm import decontaminate, simhash, toxicity
from siftmark.llm.common import local_rows, materialise


def test_stages(spark, sf, edge_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]
    docs = edge_docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, materialise(stage(spark, docs, sf), f"test-{name}")
        if i < 4:
            assert docs.columns == before.columns, name
        rows = Counter((r.doc_id, r.lang, r.source) for r in docs.collect())
        assert not rows - Counter((r.doc_id, r.lang, r.source) for r in before.collect()), name
        if name == "near_duplicates":
            parts = simhash.near_duplicates(before).collect()
            assert docs.count() == len({(r.component_id, None if r.component_id is not None else r.fingerprint) for r in parts})
            again = simhash.near_duplicates(docs).groupBy("component_id").count().where("count > 1 and component_id is not null")
            assert again.count() == 0
        elif name == "decontamination":
            leaks = {r.doc_id for r in decontaminate.find_leaks(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - leaks
        elif name == "pii":
            assert docs.count() == before.count()
            assert docs.where("n_chars is not null and text is not null and n_chars <> length(text)").count() == 0
            assert docs.where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+")).count() == 0
    assert docs.where("copies < 1 or copies > 3").count() == 0 and docs.count()


def test_empty_documents(spark, sf, edge_docs):
    docs = edge_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.collect() == []


def test_texts_come_in_small_pieces(spark, sf, edge_docs):
    """Executors keep what the largest batch took, so no stage hands out thousands of whole texts at once."""
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, edge_docs.limit(0), sf)
        long = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("word "), 4000).alias("text"))
        sizes = long.mapInArrow(lambda batches: (pa.record_batch({"n": [b.num_rows]}) for b in batches), "n long")
        assert sizes.agg(F.max("n"), F.sum("n")).first()[:] == (sizes.first().n, 2000) and sizes.first().n * 20000 <= 2 << 20
        assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 1024


def test_doubts_are_local_rows(spark):
    """The pairs are not sorted and dealt by their few count classes, and no RDD of Python rows is made."""
    rows = spark.range(0, 5000, 1, 3).select((F.col("id") % 7).alias("c0"), F.lit(3).alias("b"), "id")
    told = toxicity._moved(rows, "c0", F.lit(2.0), [(5, 3, 0.0), (4, 3, 0.9), (1, 9, 0.0)], 0.1, 0.5, 0.0, "x0")
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ExistingRDD" not in plan
    assert {(r.c0, round(r.x0, 9)) for r in told.collect()} == {*((c, 0.0) for c in range(6)), (6, 4.0)}
    empty = toxicity._moved(rows, "c0", F.lit(2.0), [], 0.1, 0.5, 0.0, "x0")
    assert empty.agg(F.count("*"), F.sum(F.abs("x0"))).first()[:] == (5000, 0.0)


def test_local_rows(spark):
    rows = [("a", ["x", None], 1.5), (None, [], None)]
    assert [tuple(r) for r in local_rows(spark, rows, "a string, b array<string>, c double").collect()] == rows
    assert local_rows(spark, [], "a string, b int").collect() == []
