"""The mix of the pipeline: every source near its target, and rows as often as the plan says."""

import corpus_pipeline

from lithic.llm import mixing
from lithic.llm.common import table

SF = "/root/testdata/sf0.001"


def test_every_source_is_near_its_target(spark):
    docs = table(spark, SF, "documents").cache()
    plan = mixing.mix_sources(docs).collect()
    taken = corpus_pipeline.source_mix(spark, docs, SF).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in taken} == {r.doc_id: r.copies for r in plan if r.copies}
    for source in {r.source for r in plan}:
        mine = [r for r in plan if r.source == source]
        off = abs(sum(r.taken for r in mine) - mine[0].target)
        assert off <= max(0.01 * mine[0].target, 0.5 * max(r["size"] for r in mine)) and all(r.copies <= 3 for r in mine)
