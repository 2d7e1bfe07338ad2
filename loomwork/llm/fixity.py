"""Fixity audit of WARC replicas by Merkle trees over ordered offset ranges.

A record is hashed, records that start in the same range of ``RANGE`` bytes of an archive are hashed together in order
of their offsets, ``FAN`` neighbouring ranges are hashed into a node, and so on up to a root per archive. Two replicas
with equal roots are equal. Where roots differ, only the children of differing nodes are compared on each level, down
to the records, so what is looked at follows the damage and not the size of the archives.

Ranges are keyed by the offset itself, so no task ever holds an archive: a group is one range of records or ``FAN``
nodes, however large or hot an archive is. The number of levels follows from the greatest offset.

Cases: an archive or record that one replica lacks is reported as missing or extra; records that repeat an offset are
compared as a sorted whole; null payloads are empty; empty tables give an empty audit; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm.common import small, table, written

RANGE, FAN = 1 << 16, 64
PER_ARCHIVE = 1000


def record_bytes(url: Column, payload: Column) -> Column:
    """A response record as WARC/1.0 frames it; a null payload is empty."""
    payload = F.coalesce(payload, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, payload, F.lit("\r\n\r\n"))


def levels(records: DataFrame, depth: int, name: str) -> list[DataFrame]:
    """Nodes ``(archive, idx, hash)`` of each level from the ranges up to the root, each level written once."""
    line = F.concat_ws(":", F.col("offset"), F.col("length"), F.col("digest"))
    keyed = records.select("archive", F.expr(f"offset div {RANGE}").alias("idx"), F.struct("offset", line.alias("line")).alias("r"))
    nodes = keyed.groupBy("archive", "idx").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    nodes = written(nodes.select("archive", "idx", F.sha2(F.array_join("rs.line", "\n").cast("binary"), 256).alias("hash")), f"{name}-0")
    found = [nodes]
    for k in range(1, depth + 1):
        line = F.struct("idx", F.concat_ws(":", "idx", "hash").alias("line")).alias("r")
        up = found[-1].select("archive", F.expr(f"idx div {FAN}").alias("idx"), line).groupBy("archive", "idx")
        up = up.agg(F.array_sort(F.collect_list("r")).alias("rs"))
        found.append(written(up.select("archive", "idx", F.sha2(F.array_join("rs.line", "\n").cast("binary"), 256).alias("hash")), f"{name}-{k}"))
    return found


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of nodes that one side lacks or has with another hash."""
    a, b = (x.select("archive", "idx", F.col("hash").alias(h)) for x, h in ((a, "ha"), (b, "hb")))
    both = a.join(b, ["archive", "idx"], "full_outer")
    return both.where(~F.col("ha").eqNullSafe(F.col("hb"))).select("archive", "idx")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records of replica ``b`` that differ from ``a``; both have ``archive, offset, length, digest``.

    ``status`` is missing, extra, resized (another length) or altered.
    """
    last = max((r[0] or 0) for r in a.agg(F.max("offset")).union(b.agg(F.max("offset"))).collect())
    depth, reach = 0, RANGE
    while reach <= last:
        depth, reach = depth + 1, reach * FAN
    ta, tb = levels(a, depth, "fixity-a"), levels(b, depth, "fixity-b")
    bad = written(differing(ta[-1], tb[-1]), "fixity-roots")
    for k in range(depth - 1, -1, -1):
        parents = small(bad.select("archive", F.col("idx").alias("parent")))
        below = [x[k].withColumn("parent", F.expr(f"idx div {FAN}")).join(parents, ["archive", "parent"], "left_semi") for x in (ta, tb)]
        bad = written(differing(*below), f"fixity-bad-{k}")
    ranges = small(bad)
    left, right = (x.withColumn("idx", F.expr(f"offset div {RANGE}")).join(ranges, ["archive", "idx"], "left_semi") for x in (a, b))
    fold = [F.sum("length").alias("length"), F.concat_ws(",", F.array_sort(F.collect_list("digest"))).alias("digest")]
    left, right = (x.groupBy("archive", "offset").agg(*fold).withColumnsRenamed({"length": f"length_{s}", "digest": f"digest_{s}"})
                   for x, s in ((left, "a"), (right, "b")))
    both = left.join(right, ["archive", "offset"], "full_outer").where("NOT digest_a <=> digest_b OR NOT length_a <=> length_b")
    status = (F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra")
              .when(F.col("length_a") != F.col("length_b"), "resized").otherwise("altered"))
    return both.select("archive", "offset", "length_a", "length_b", "digest_a", "digest_b", status.alias("status"))


def replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two replicas of the pages laid out as archives of ``PER_ARCHIVE`` ids, the second one with planted damage.

    The tables have no second replica, so one is derived: by a hash of the id a page in 256 is altered, one cut short
    and one lost. Both replicas are indexed by the offsets at which the records were written.
    """
    key = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 2)
    damaged = (F.when(key == "00", F.replace(F.col("html"), F.lit("</p>"), F.lit("</q>")))
               .when(key == "01", F.expr("substring(html, 1, length(html) div 2)")).otherwise(F.col("html")))
    here, there = record_bytes(F.col("url"), F.col("html")), record_bytes(F.col("url"), damaged)
    archive = F.coalesce(F.format_string("crawl-%08d", F.expr(f"page_id div {PER_ARCHIVE}")),
                         F.format_string("loose-%04d", F.pmod(F.xxhash64("url", "html"), F.lit(10_000))))
    rows = written(pages.select(
        archive.alias("archive"), "page_id", F.octet_length(here).cast("long").alias("len_a"), F.octet_length(there).cast("long").alias("len_b"),
        F.sha2(here.cast("binary"), 256).alias("dig_a"), F.sha2(there.cast("binary"), 256).alias("dig_b"), (key == "02").alias("lost")), "fixity-records")
    before = Window.partitionBy("archive").orderBy("page_id", "dig_a").rowsBetween(Window.unboundedPreceding, -1)
    rows = written(rows.withColumn("offset", F.coalesce(F.sum("len_a").over(before), F.lit(0))), "fixity-index")
    a, b = (rows.select("archive", "offset", F.col(f"len_{s}").alias("length"), F.col(f"dig_{s}").alias("digest"), "lost") for s in "ab")
    return a.drop("lost"), b.where("NOT lost").drop("lost")


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(*replicas(table(spark, sf_dir, "pages")))


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 2) AS k FROM pages),
d AS (
  SELECT *, CASE WHEN k = '00' THEN replace(html, '</p>', '</q>') WHEN k = '01' THEN substr(html, 1, length(html) // 2) ELSE html END AS other FROM p),
r AS (
  SELECT printf('crawl-%08d', page_id // 1000) AS archive, page_id, k,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS a,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(other) || chr(13) || chr(10) || chr(13) || chr(10) || other || chr(13) || chr(10) || chr(13) || chr(10) AS b
  FROM d),
o AS (
  SELECT *, CAST(coalesce(sum(strlen(a)) OVER (PARTITION BY archive ORDER BY page_id, sha256(a)
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r)
SELECT archive, "offset", strlen(a) AS length_a, CASE WHEN k = '02' THEN NULL ELSE strlen(b) END AS length_b, sha256(a) AS digest_a,
  CASE WHEN k = '02' THEN NULL ELSE sha256(b) END AS digest_b,
  CASE WHEN k = '02' THEN 'missing' WHEN strlen(a) <> strlen(b) THEN 'resized' ELSE 'altered' END AS status
FROM o WHERE k = '02' OR a <> b
"""
