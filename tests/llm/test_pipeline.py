"""The corpus pipeline, stage by stage."""

import corpus_pipeline
from kpivane.llm import pii, queries
from kpivane.sources.stage import settled
from tests.llm.test_neardup import brute
from tests.llm.test_packing import gapless
from tests.support import DATA

PATH = f"{DATA}/sf0.001"


def test_each_stage_takes_effect(spark):
    docs = queries.table(spark, PATH, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settled(stage(spark, docs, PATH))
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns and 0 < docs.count()
    before, after = kept["quality"]
    scores = {r.doc_id: r.predicted for r in queries.op4_quality(spark, PATH).collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if scores[r.doc_id]}
    before, after = kept["near_duplicates"]
    found = brute([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, c) in found.items() if i == c)
    before, after = kept["personal_data"]
    assert after.count() == before.count() and after.where(pii.count_of("email", pii.base_spans("text")) > 0).count() == 0
    before, after = kept["mixing"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    before, after = kept["packing"]
    gapless(after.collect(), corpus_pipeline.CAPACITY)
    assert after.where("piece = 0").count() == before.count()


def test_run_gives_packed_sequences(spark):
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, PATH).columns)
