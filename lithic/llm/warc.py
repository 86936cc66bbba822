"""WARC archives and a Merkle fixity audit of their replicas."""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.llm.common import small, stage, table, task

#: Bytes of an archive under a lowest node, children of a node, and levels of nodes below the root.
RANGE, FAN_OUT, LEVELS = 1 << 16, 16, 3
#: Page ids that share an archive.
ARCHIVE_IDS = 1_024

CRLF = "\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as the bytes of a WARC/1.0 resource record; nulls count as empty."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2),
    )
    return F.concat(head.cast("binary"), body, F.lit(CRLF * 2).cast("binary"))


def _laid_out(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Offsets of records (archive, page_id, url, tie, length and `columns`) laid end to end by id, url and tie.

    Records are dealt over ranges of the whole order, summed up within a range, and moved on by the
    sums of the ranges before, so an archive of any number of records is no single task's.
    """
    place = ["archive", "page_id", "url", "tie"]
    dealt = stage(rows.repartitionByRange(*place).withColumn("range", F.spark_partition_id()), "ranges")
    before = F.sum("bytes").over(Window.partitionBy("archive").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = stage(dealt.groupBy("archive", "range").agg(F.sum("length").alias("bytes")).withColumn("before", F.coalesce(before, F.lit(0))), "sums")
    within = F.sum("length").over(Window.partitionBy("archive", "range").orderBy("page_id", "url", "tie").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("within", within).join(small(sums.drop("bytes")), ["archive", "range"]).select("archive", (F.col("before") + F.col("within") - F.col("length")).alias("offset"), "length", "page_id", *columns)


def _pages(pages: DataFrame, ids: int) -> DataFrame:
    """Pages with nulls as empty texts, their archive, and the html once more (`tie`) where id and url repeat."""
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    given = given.withColumn("archive", F.coalesce(F.floor(F.col("page_id") / ids), F.lit(-1)).cast("long"))
    odd = small(stage(given.groupBy("page_id", "url").count().where("count > 1").select(F.col("page_id").alias("__id"), F.col("url").alias("__url")), "odd"))
    marked = given.join(odd, given["page_id"].eqNullSafe(odd["__id"]) & (given["url"] == odd["__url"]), "left")
    return marked.withColumn("tie", F.when(F.col("__url").isNotNull(), F.col("html"))).drop("__id", "__url")


def archive_pages(pages: DataFrame, ids: int = ARCHIVE_IDS) -> DataFrame:
    """archive, offset, length, page_id, content: pages as records one after the other, by id, url and text.

    An archive holds `ids` successive ids, pages without an id go to archive -1.
    """
    rows = _pages(pages, ids).withColumn("content", record(F.col("page_id"), F.col("url"), F.col("html"))).drop("html")
    return _laid_out(rows.withColumn("length", F.octet_length("content").cast("long")), ["content"])


def unpacked(data: bytes) -> bytes:
    """An archive without its compression, as a whole or by record; one cut short or damaged as far as it goes."""
    out = []
    while data[:2] == b"\x1f\x8b":
        unpack = zlib.decompressobj(16 + zlib.MAX_WBITS)
        try:
            out.append(unpack.decompress(data) + unpack.flush())
        except zlib.error:
            break
        data = unpack.unused_data
    else:
        if not out:
            return data
    return b"".join(out)


def parse(data: bytes):
    """(offset, length, headers, payload) of each record of an archive, plain or gzipped as a whole or by record.

    Offsets and lengths are those in the archive unpacked. What does not begin a record is skipped up
    to the next one; a record cut short is returned as far as it goes.
    """
    data = unpacked(data)
    at = data.find(b"WARC/")
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            yield at, len(data) - at, {}, b""
            return
        lines = data[at:end].split(b"\r\n")[1:]
        headers = {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}
        n = int(headers["content-length"]) if re.fullmatch(r"\d+", headers.get("content-length", "")) else 0
        payload = data[end + 4 : end + 4 + n]
        stop = min(len(data), end + 4 + n + 4)
        yield at, stop - at, headers, payload
        at = data.find(b"WARC/", stop)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive (file name), offset, length, page_id (from the record's id, if it has one), content of WARC files; a file is one piece of work."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                plain = unpacked(data)
                rows = []
                for offset, length, headers, _ in parse(plain):
                    found = re.fullmatch(r"<urn:page:(-?\d+)>", headers.get("warc-record-id", ""))
                    rows.append((name.rsplit("/", 1)[-1], offset, length, int(found[1]) if found else None, plain[offset : offset + length]))
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["archive", "offset", "length", "page_id", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(task(run, 1), "archive string, offset long, length long, page_id long, content binary")


def leaves(records: DataFrame) -> DataFrame:
    """Records (archive, offset, length, content and others) with `hash` (SHA-256 of the bytes) in place of their content.

    What a leaf adds to its tree also covers its place: see `tree`.
    """
    return records.withColumn("hash", F.unhex(F.sha2("content", 256))).drop("content")


def _join(children: Column) -> Column:
    """SHA-256 over children's places and hashes in order."""
    text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["at"].cast("string"), c["length"].cast("string"), F.hex(c["hash"]))), "|")
    return F.unhex(F.sha2(text.cast("binary"), 256))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Nodes (archive, node, hash) by level over leaves (archive, offset, length, hash), lowest first, roots last.

    A lowest node covers RANGE bytes of offsets, a node above FAN_OUT nodes, the root all. A node is
    gathered from its own children only, so no group holds more than a range's records or FAN_OUT
    hashes, and a root what the top level leaves (16 for an archive of 4 GB). Each level is written
    before the next is gathered from it.
    """
    none = F.lit(0).cast("long")
    out, df, at, length, width = [], leaf, F.col("offset"), F.col("length"), RANGE
    for level in range(LEVELS + 2):
        node = none if level == LEVELS + 1 else F.floor(at / width).cast("long")
        child = F.struct(at.alias("at"), length.alias("length"), "hash")
        df = stage(df.groupBy("archive", node.alias("node")).agg(_join(F.sort_array(F.collect_list(child))).alias("hash")), f"level{level}")
        out.append(df)
        at, length, width = F.col("node"), none, FAN_OUT
    return out


def audit(first: DataFrame, second: DataFrame, by: list[str] = ()) -> DataFrame:
    """Compare two replicas (archive, offset, length, content, and the columns of `by`).

    Roots are compared first; only under nodes whose hashes differ, or that one replica lacks, are the
    children compared, down to records. Returns a row per record of either replica: archive, offset,
    length and `by` (of the first replica where it has the record), record_sha256 and status: intact,
    changed (other bytes or length at the same offset), missing (only the first has it) or extra.

    Several records at one offset are compared as one lot: all are changed if the lots differ. Null
    archives are one archive; null content counts as empty. No rows: no rows. Other columns are ignored.
    """

    def hashed(records):
        ready = records.select(F.col("archive").cast("string").alias("archive"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"), F.coalesce("length", F.lit(0)).cast("long").alias("length"), *by, F.coalesce("content", F.lit("").cast("binary")).alias("content"))
        return stage(leaves(ready.withColumn("archive", F.coalesce("archive", F.lit("")))), "leaves")

    return audit_leaves(hashed(first), hashed(second), by)


def audit_leaves(leaf_a: DataFrame, leaf_b: DataFrame, by: list[str] = (), opened: list | None = None) -> DataFrame:
    """`audit` over staged leaves (archive string, offset, length, hash, and the columns of `by`).

    The number of nodes compared on each level, roots first, is appended to `opened` if it is given.
    """
    a, b = tree(leaf_a), tree(leaf_b)

    # Roots, then down: parents that differ pick the children to compare.
    suspect = None
    for level in range(len(a) - 1, -1, -1):
        x, y = (side[level].select("archive", "node", F.col("hash").alias(h)) for side, h in ((a, "ha"), (b, "hb")))
        if suspect is not None:
            up = (F.floor(F.col("node") / FAN_OUT) if level < len(a) - 2 else F.lit(0)).cast("long")
            x, y = (n.withColumn("parent", up).join(suspect, ["archive", "parent"], "left_semi").drop("parent") for n in (x, y))
        met = x.join(y, ["archive", "node"], "full_outer")
        if opened is not None:
            opened.append(met.count())
        differ = met.where(~F.col("ha").eqNullSafe(F.col("hb")))
        suspect = small(stage(differ.select("archive", F.col("node").alias("parent")), "suspect"))

    def lots(leaf, name):
        under = leaf.withColumn("parent", F.floor(F.col("offset") / RANGE).cast("long")).join(suspect, ["archive", "parent"], "left_semi")
        return under.groupBy("archive", "offset").agg(_join(F.sort_array(F.collect_list(F.struct(F.col("offset").alias("at"), "length", "hash")))).alias(name))

    found = lots(leaf_a, "ha").join(lots(leaf_b, "hb"), ["archive", "offset"], "full_outer")
    state = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").when(F.col("ha") == F.col("hb"), "intact").otherwise("changed")
    found = small(stage(found.select("archive", "offset", state.alias("status")).where("status <> 'intact'"), "found"))
    shown = ["archive", "offset", "length", *by, F.lower(F.hex("hash")).alias("record_sha256")]
    kept = leaf_a.join(found, ["archive", "offset"], "left").select(*shown, F.coalesce("status", F.lit("intact")).alias("status"))
    extra = leaf_b.join(found.where("status = 'extra'"), ["archive", "offset"]).select(*shown, "status")
    return kept.unionByName(extra)


def replicas(pages: DataFrame, ids: int = ARCHIVE_IDS) -> tuple[DataFrame, DataFrame]:
    """Leaves of the pages' archives and of the query's second replica, staged.

    In the replica pages with an id that leaves 7 by 50 have their last byte changed, and those that
    leave 5 by 113 are lost. Records are built, measured and hashed where the pages are read, once for
    both; only hashes, lengths, ids and urls are moved to lay records end to end.
    """
    content = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = _pages(pages, ids).withColumn("content", content).drop("html").withColumn("length", F.octet_length("content").cast("long"))
    broken = F.expr("overlay(content PLACING X'7E' FROM cast(length AS int) FOR 1)")
    hash_ = F.unhex(F.sha2("content", 256))
    other = F.when(F.col("page_id") % 113 == 5, None).when(F.col("page_id") % 50 == 7, F.unhex(F.sha2(broken, 256))).otherwise(hash_)
    rows = stage(rows.withColumn("hash", hash_).withColumn("other", other).drop("content"), "hashed")
    laid = stage(_laid_out(rows, ["hash", "other"]).withColumn("archive", F.col("archive").cast("string")), "leaves")
    return laid.drop("other"), laid.where("other is not null").drop("hash").withColumnRenamed("other", "hash")


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = replicas(table(spark, sf_dir, "pages"))
    return audit_leaves(first, second, ["page_id"]).select("page_id", "archive", "offset", "length", "record_sha256", "status")


ORACLE = f"""
WITH r AS (
  SELECT page_id, coalesce(floor(page_id / {ARCHIVE_IDS})::BIGINT, -1) AS archive, coalesce(url, '') AS url, coalesce(html, '') AS html,
    concat('WARC/1.0', e, 'WARC-Type: resource', e, 'WARC-Record-ID: <urn:page:', page_id, '>', e, 'WARC-Target-URI: ', url, e, 'Content-Type: text/html', e,
           'Content-Length: ', strlen(coalesce(html, '')), e, e, coalesce(html, ''), e, e) AS record
  FROM pages, (SELECT chr(13) || chr(10) AS e))
SELECT page_id, archive::VARCHAR AS archive,
  (sum(strlen(record)) OVER (PARTITION BY archive ORDER BY page_id NULLS FIRST, url, html ROWS UNBOUNDED PRECEDING) - strlen(record))::BIGINT AS "offset",
  strlen(record)::BIGINT AS length, sha256(record) AS record_sha256,
  CASE WHEN page_id % 113 = 5 THEN 'missing' WHEN page_id % 50 = 7 THEN 'changed' ELSE 'intact' END AS status
FROM r
"""
