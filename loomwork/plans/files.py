"""Queries that write files of texts, subtitles, configurations and reports and read them again, and canonical forms of JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import json
from loomwork.operators import policies, reports
from loomwork.plans import tables as T
from loomwork.sources import shared
from loomwork.sources import text as sources

#: Suppliers that share a file.
BLOCK = 50


def _files(rows, path, key="k"):
    """One file for each row's text, in a folder named by its key."""
    rows.select(F.col(key).cast("string").alias("k"), "value").repartition("k").write.option("lineSep", "\n").partitionBy("k").text(path)
    return f"{path}/*/*.txt"


def _name(path):
    """The key in a file's path."""
    return F.regexp_extract(path, "/k=([^/]*)/", 1)


def subtitle_files(spark, d):
    """Suppliers as cues of subtitle files, every other file as VTT, and every third with a byte order mark."""
    s = T.table(spark, d, "supplier")
    k, n = F.col("s_suppkey"), F.floor(F.col("s_suppkey") / BLOCK)
    clock = lambda t, dot: F.format_string("%02d:%02d:%02d" + dot + "%03d", F.floor(t / 3600), F.floor(t / 60) % 60, t % 60, k % 1000)
    time = lambda t: F.when(n % 2 == 0, clock(t, ",")).otherwise(clock(t, "."))
    cue = F.concat(k.cast("string"), F.lit("\n"), time(k), F.lit(" --> "), time(k + 2), F.lit("\n<i>"), "s_name", F.lit("</i>\nis  of "), F.col("s_nationkey").cast("string"))
    files = s.groupBy(n.alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("o"), cue.alias("c")))), lambda x: x["c"]).alias("cues"))
    head = F.when(F.col("k") % 2 == 1, F.lit("WEBVTT\n\n")).otherwise("")
    value = F.concat(F.when(F.col("k") % 3 == 0, F.lit("\ufeff")).otherwise(""), head, F.array_join("cues", "\n\n"))
    path = _files(files.select("k", value.alias("value")), shared.folder(spark, "subtitles"))
    rows = sources.texts(spark, path).select(_name(F.col("path")).cast("long").alias("file"), F.explode(sources.cues(F.col("text"))).alias("c"))
    return rows.select("file", F.round("c.start", 3).alias("begins"), F.round("c.end", 3).alias("ends"), "c.text")


def inspected_files(spark, d):
    """Suppliers as files of several kinds, judged by size, leading bytes, directory and trailer."""
    s = T.table(spark, d, "supplier").groupBy(F.floor(F.col("s_suppkey") / 10).alias("k")).agg(F.count("*").cast("int").alias("n"))
    kind = F.col("k") % 5
    head = F.when(kind < 2, "%PDF-1.7").when(kind == 2, "PK\x03\x04").otherwise("text")
    value = F.concat(head, F.repeat(F.lit(" word"), F.col("n")), F.when(kind == 1, " trailer << /Encrypt 5 0 R >>").when(kind == 4, F.repeat(F.lit("."), F.lit(200))).otherwise(""))
    path = _files(s.select("k", value.alias("value")), shared.folder(spark, "inspected"))
    rows = sources.inspected(spark, path, most=200)
    return rows.select(_name(F.col("path")).cast("long").alias("file"), "length", "kind", "problem")


def pool_files(spark, d):
    """Suppliers as groups and deployments of configurations, with and without what has a default, and read again as deployments."""
    s = T.table(spark, d, "supplier")
    k, n = F.col("s_suppkey"), F.floor(F.col("s_suppkey") / BLOCK)
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    keys = F.transform(F.sequence(F.lit(1), (k % 4 + 1).cast("int")), lambda i: F.struct(text("key", i).alias("id"), F.when(i > 2, "revoked").otherwise(F.when(i == 1, "active")).alias("status")))
    group = F.struct(text("g", k).alias("id"), text("p", F.col("s_nationkey")).alias("provider"), F.when(k % 2 == 0, "free").otherwise("paid").alias("tier"),
                     F.when(k % 3 > 0, "no_training").alias("data_policy"), F.when(k % 5 == 0, F.lit(False)).alias("enabled"), keys.alias("credentials"))
    deployment = F.struct(text("d", k).alias("id"), text("g", k).alias("group"), text("m", n).alias("model"), F.when(k % 4 == 0, F.lit(2.5)).alias("weight"), F.when(k % 7 > 0, "list").alias("price_mode"))
    model = F.array(F.struct(text("m", F.col("k")).alias("id"), F.when(F.col("k") % 2 == 0, "json_schema").alias("structured"), (F.col("k") * 1000 + 8000).alias("ctx_in"), F.when(F.col("k") % 3 == 0, F.lit(True)).alias("vision")))
    files = s.groupBy(n.alias("k")).agg(F.collect_list(group).alias("groups"), F.collect_list(deployment).alias("deployments"))
    value = F.to_json(F.struct(model.alias("models"), "groups", "deployments"))
    path = _files(files.select("k", value.alias("value")), shared.folder(spark, "pool"))
    rows = sources.pool_deployments(spark, path)
    return rows.select("deployment", "group_id", "enabled", "active_credentials", "structured", "vision", "data_policy", "price_mode", "ctx_in", "tier", "weight", F.array_join("allowed_gates", ",").alias("gates"))


def report_pages(spark, d):
    """Documents as sections of a report, as Markdown and as html."""
    rows = T.table(spark, d, "documents").select(F.col("doc_id").alias("section"), F.coalesce("text", F.lit("")).alias("text"))
    out = [reports.page("Corpus", rows, kind).select("section", F.lit(kind).alias("kind"), F.length("value").alias("n"), F.md5("value").alias("md5")) for kind in ("md", "html")]
    return out[0].unionByName(out[1])


def audit_sample(spark, d):
    """A tenth of the cited core units, the same ones at every run."""
    i = T.table(spark, d, "lineitem").where("l_returnflag = 'A'")
    return policies.hash_sample(i.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit"), "l_partkey"), "unit", 10)


def canonical_forms(spark, d):
    """Orders as JSON with blanks and keys in another order: its canonical form and digest; null where it is broken."""
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit(' { "z" : '), k, F.lit(', "a":["é", null ,true], "m": {"y":1.5,"b" :"'), "o_orderpriority", F.lit('"} } '))
    reply = F.when(F.col("o_orderkey") % 11 == 0, F.substring(text, 1, 20)).otherwise(text)
    return T.table(spark, d, "orders").select("o_orderkey", json.canonical_json(reply).alias("canonical"), json.content_sha256(reply).alias("sha256"))


_CLOCK = "round({t} + s_suppkey % 1000 / 1000.0::DOUBLE, 3)"

QUERIES = {
    "subtitle_files": (subtitle_files, f"""
SELECT s_suppkey // {BLOCK} AS file, {_CLOCK.format(t='s_suppkey')} AS begins, {_CLOCK.format(t='(s_suppkey + 2)')} AS ends, s_name || ' is of ' || s_nationkey AS text FROM supplier"""),
    "inspected_files": (inspected_files, """
WITH f AS (SELECT s_suppkey // 10 AS file, count(*) AS n FROM supplier GROUP BY 1),
x AS (SELECT file, file % 5 AS k, CASE WHEN file % 5 < 2 THEN 8 ELSE 4 END + 5 * n + CASE file % 5 WHEN 1 THEN 29 WHEN 4 THEN 200 ELSE 0 END + 1 AS length FROM f)
SELECT file, length, CASE WHEN k < 2 THEN 'pdf' WHEN k = 2 THEN 'zip' ELSE 'text' END AS kind,
  CASE WHEN length > 200 THEN 'too_big' WHEN k = 1 THEN 'encrypted' WHEN k = 2 THEN 'odd_archive' END AS problem FROM x"""),
    "pool_files": (pool_files, f"""
SELECT 'd' || s_suppkey AS deployment, 'g' || s_suppkey AS group_id, s_suppkey % 5 > 0 AS enabled, CAST(least(s_suppkey % 4 + 1, 2) AS INT) AS active_credentials,
  CASE WHEN s_suppkey // {BLOCK} % 2 = 0 THEN 'json_schema' ELSE 'none' END AS structured, s_suppkey // {BLOCK} % 3 = 0 AS vision, CASE WHEN s_suppkey % 3 > 0 THEN 'no_training' ELSE 'unknown' END AS data_policy,
  CASE WHEN s_suppkey % 7 > 0 THEN 'list' ELSE 'free' END AS price_mode, s_suppkey // {BLOCK} * 1000 + 8000 AS ctx_in, CASE WHEN s_suppkey % 2 = 0 THEN 'free' ELSE 'paid' END AS tier,
  CASE WHEN s_suppkey % 4 = 0 THEN 2.5::DOUBLE ELSE 1 END AS weight, 'dev,A,B,C' AS gates FROM supplier"""),
    "report_pages": (report_pages, """
WITH t AS (SELECT doc_id AS section, coalesce(text, '') AS text FROM documents),
v AS (SELECT section, 'md' AS kind, '## ' || section || chr(10) || chr(10) || text || chr(10) AS v FROM t UNION ALL SELECT section, 'html', '<section title="Corpus"><h2>' || section || '</h2><p>'
  || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10) || chr(10), '</p><p>') || '</p></section>' FROM t)
SELECT section, kind, CAST(length(v) AS INT) AS n, md5(v) AS md5 FROM v"""),
    "audit_sample": (audit_sample, """
SELECT l_orderkey * 10 + l_linenumber AS unit, l_partkey FROM lineitem WHERE l_returnflag = 'A' AND CAST('0x' || substr(md5(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 10"""),
    "canonical_forms": (canonical_forms, """
WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN '{"a":["é",null,true],"m":{"b":"' || o_orderpriority || '","y":1.5},"z":' || o_orderkey || '}' END AS canonical FROM orders)
SELECT *, sha256(canonical) AS sha256 FROM c"""),
}
