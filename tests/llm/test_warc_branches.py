"""The query's replicas against its general form, only differing branches opened, and archives cut short."""

import gzip

from pyspark.sql import functions as F

from lithic.llm import warc

PAGES = "page_id long, url string, html string"


def test_leaves_of_the_query_equal_the_general_form(spark):
    rows = [(i, f"u{i % 7}", f"<p>é{i}" * (i % 90)) for i in range(2500)] + [(None, f"n{i % 3}", f"h{i % 5}") for i in range(60)] + [(8, "u1", "b"), (8, "u1", "a"), (8, None, None)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("range", F.lit(1)).withColumn("tie", F.lit("x"))
    first, second = warc.replicas(pages)
    records = warc.archive_pages(pages)
    want = sorted((str(r.archive), r.offset, r.length, str(r.page_id), bytes(r["hash"])) for r in warc.leaves(records).collect())
    assert sorted((r.archive, r.offset, r.length, str(r.page_id), bytes(r["hash"])) for r in first.collect()) == want
    ends = {}
    for archive, offset, length, *_ in sorted(want, key=lambda r: (r[0], r[1])):
        assert offset == ends.get(archive, 0)
        ends[archive] = offset + length
    assert second.count() == sum(not (r[0] is not None and r[0] % 113 == 5) for r in rows)
    got = {(r.page_id, r.status) for r in warc.audit_leaves(first, second, ["page_id"]).collect() if r.status != "intact"}
    assert got == {(r[0], "missing" if r[0] % 113 == 5 else "changed") for r in rows if r[0] is not None and (r[0] % 113 == 5 or r[0] % 50 == 7)}


def test_only_differing_branches_are_opened(spark):
    pages = spark.createDataFrame([(i, "u", "x" * 4000) for i in range(6000)], PAGES)
    leaf = warc.leaves(warc.archive_pages(pages).withColumn("archive", F.col("archive").cast("string"))).cache()
    same = []
    assert warc.audit_leaves(leaf, leaf, ["page_id"], same).where("status <> 'intact'").count() == 0
    assert same[0] == 6 and same[1:] == [0] * (len(same) - 1)
    broken = leaf.withColumn("hash", F.when(F.col("page_id") == 3000, F.unhex(F.lit("00"))).otherwise(F.col("hash")))
    seen = []
    assert [r.page_id for r in warc.audit_leaves(leaf, broken, ["page_id"], seen).where("status = 'changed'").collect()] == [3000]
    assert seen[0] == 6 and all(n <= warc.FAN_OUT for n in seen[1:])


def test_an_archive_cut_short_is_read_as_far_as_it_goes(spark, tmp_path):
    record = lambda i: b"WARC/1.0\r\nWARC-Record-ID: <urn:page:" + str(i).encode() + b">\r\nContent-Length: 3000\r\n\r\n" + (bytes(range(256)) * 12)[:3000] + b"\r\n\r\n"
    whole = b"".join(gzip.compress(record(i)) for i in range(4))
    (tmp_path / "a.warc.gz").write_bytes(whole[:-20])
    (tmp_path / "b.warc.gz").write_bytes(b"\x1f\x8bnothing")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert {r.page_id for r in got} >= {0, 1, 2} and {r.archive for r in got} == {"a.warc.gz"}
