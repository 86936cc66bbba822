"""The pipeline against a plain version of each stage on its own input."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from lithic.llm import simhash
from lithic.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "pack"]
    docs = table(spark, SF, "documents")
    columns, inputs = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        inputs[name] = docs.toPandas()
        docs = function(spark, docs, SF)
        if name != "pack":
            assert docs.columns == columns
            docs = docs.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else docs.cache()
    out = docs.toPandas()
    labels = table(spark, SF, "labels").toPandas()

    # Quality: nothing is made up, clean documents stay.
    kept = set(inputs["exact_dedup"].doc_id)
    clean = set(labels[(labels.quality == 1)].doc_id) & set(inputs["quality"].doc_id)
    assert kept <= set(inputs["quality"].doc_id) and len(clean & kept) >= 0.97 * len(clean)

    # Exact: one of each squeezed text, the longest original with the smallest id.
    best = {}
    for r in inputs["exact_dedup"].itertuples():
        k = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[k] = min(best.get(k, (0, 1 << 60)), (-len(r.text), r.doc_id))
    assert sorted(inputs["near_dedup"].doc_id) == sorted(i for _, i in best.values())

    # Near: the smallest id of each component.
    rows = list(inputs["near_dedup"].itertuples())
    prints = [simhash.simhash(r.text.encode()) for r in rows]
    label = [r.doc_id for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if label[i] != label[j] and (prints[i] ^ prints[j]).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    assert sorted(set(inputs["mix"].doc_id)) == sorted(set(label))

    # Mix: no document over three times, every source near its target.
    times = inputs["pack"].doc_id.value_counts()
    assert times.max() <= 3 and set(times.index) <= set(inputs["mix"].doc_id)

    # Pack: every copy once, gapless.
    assert len(out[out.piece == 0]) == len(inputs["pack"])
    ends = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (out.sort_values(["sequence_id", "offset"]).offset == ends.length.cumsum() - out.sort_values(["sequence_id", "offset"]).length).all()

    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == out.length.sum()


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "one two three four five", "en", "a", 1), (1, "one two three four five", "en", "a", 1), (1, "something else altogether here now", "en", "a", 1), (None, "one  two three four five", "en", "b", 1), (None, None, None, None, None), (2, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.exact_copies(spark, docs, SF).collect()
    assert sorted((r.text or "") for r in once) == ["", "one  two three four five", "something else altogether here now"]
    near = corpus_pipeline.near_copies(spark, docs, SF).collect()
    assert len({simhash.simhash((r.text or "").encode()) for r in near}) == len(near) == 3
    assert corpus_pipeline.near_copies(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.source_mix(spark, docs.limit(0), SF).count() == 0
