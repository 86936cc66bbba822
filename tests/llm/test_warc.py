"""WARC records and the fixity audit: round trips, every kind of damage, and that only differing branches are opened."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from lithic.llm import warc

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"https://h{i % 3}.x/{i}", "é<p>" * (i % 400)) for i in range(3000)] + [(None, None, None), (5, "u", ""), (5, "u", ""), (9, "big", "x" * 300_000)]
    return spark.createDataFrame(rows, PAGES).withColumn("hash", F.lit(1)).withColumn("offset", F.lit(1)).withColumn("node", F.lit(2))


def test_records_lie_end_to_end_and_are_read_back(spark, pages, tmp_path):
    records = warc.archive_pages(pages)
    rows = sorted(records.collect(), key=lambda r: (r.archive, r.offset))
    files = {}
    for r in rows:
        assert r.offset == len(files.setdefault(r.archive, b"")) and r.length == len(r.content)
        files[r.archive] += bytes(r.content)
    assert set(files) == {-1, 0, 1, 2}
    (tmp_path / "w").mkdir()
    for k, data in files.items():
        (tmp_path / "w" / f"{k}.warc").write_bytes(gzip.compress(data) if k == 1 else data)
    back = warc.read_archives(spark, str(tmp_path / "w"))
    got = sorted((r.archive.split(".")[0], r.offset, r.length, r.page_id, bytes(r.content)) for r in back.collect() if r.page_id is not None)
    assert got == sorted((str(r.archive), r.offset, r.length, r.page_id, bytes(r.content)) for r in rows if r.page_id is not None)


def test_parse_bears_with_damage():
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [(a, n, p) for a, n, _, p in warc.parse(one + b"junk" + one)] == [(0, len(one), b"abc"), (len(one) + 4, len(one), b"abc")]
    assert [p for *_, p in warc.parse(one[:-6])] == [b"ab"] or len(list(warc.parse(one[:-6]))) == 1
    members = gzip.compress(one) + gzip.compress(one)
    assert [p for *_, p in warc.parse(members)] == [b"abc", b"abc"] and list(warc.parse(b"")) == [] and list(warc.parse(b"nothing")) == []


def test_every_kind_of_damage_is_found(spark, pages):
    records = warc.archive_pages(pages).cache()
    clean = warc.audit(records, records.repartition(5), ["page_id"])
    assert clean.count() == 3004 and clean.where("status <> 'intact'").count() == 0
    other = records.where("page_id IS NULL OR page_id NOT IN (17, 2999)").withColumn("content", F.when(F.col("page_id") == 1500, F.concat("content", F.lit("!").cast("binary"))).otherwise(F.col("content")))
    more = records.where("page_id = 9 AND length > 200000").select("archive", (F.col("offset") + 1).alias("offset"), "length", F.lit(-9).cast("long").alias("page_id"), "content")
    new = records.where("page_id = 3").select(F.lit(77).cast("long").alias("archive"), "offset", "length", F.lit(-3).cast("long").alias("page_id"), "content")
    other = other.unionByName(more).unionByName(new)
    got = {(r.page_id, r.status) for r in warc.audit(records, other, ["page_id"]).where("status <> 'intact'").collect()}
    assert got == {(17, "missing"), (2999, "missing"), (1500, "changed"), (-9, "extra"), (-3, "extra")}
    one = records.where("page_id = 4").first()
    row = warc.audit(records, other, ["page_id"]).where("page_id = 4").first()
    assert row.record_sha256 == hashlib.sha256(bytes(one.content)).hexdigest()


def test_trees(spark, pages):
    leaf = warc.leaves(warc.archive_pages(pages).withColumn("archive", F.col("archive").cast("string"))).cache()
    levels = warc.tree(leaf)
    assert len(levels) == warc.LEVELS + 2 and levels[-1].count() == 4
    again = warc.tree(leaf.repartition(3))
    assert sorted(map(tuple, levels[-1].collect())) == sorted(map(tuple, again[-1].collect()))
    # A moved record changes the root even if its bytes don't.
    moved = leaf.withColumn("offset", F.when(F.col("page_id") == 2, F.col("offset") + 1).otherwise(F.col("offset")))
    assert warc.tree(moved)[-1].join(levels[-1], ["archive", "hash"], "left_anti").count() == 1


def test_empty_and_null(spark):
    nothing = spark.createDataFrame([], PAGES)
    assert warc.archive_pages(nothing).count() == 0
    records = spark.createDataFrame([(None, None, None, None), ("a", 0, 1, bytearray(b"x")), ("a", 0, 1, bytearray(b"x"))], "archive string, offset long, length long, content binary")
    assert [r.status for r in warc.audit(records, records).collect()] == ["intact"] * 3
    assert {r.status for r in warc.audit(records, records.limit(0)).collect()} == {"missing"} and {r.status for r in warc.audit(records.limit(0), records).collect()} == {"extra"}
    assert warc.audit(records.limit(0), records.limit(0)).count() == 0
    twice = records.where("archive = 'a'")
    assert {r.status for r in warc.audit(twice, twice.limit(1)).collect()} == {"changed"}
