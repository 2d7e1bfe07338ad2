"""Queries on styles, releases, pools, quotas, windows and extraction quality, and SQL of folds and estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import numbers, secrets, text
from loomwork.operators import (
    checks,
    evidence,
    glossary,
    ledger,
    paragraphs,
    policies,
    pool,
    queue,
    reports,
    styles,
)
from loomwork.plans import tables as T
from loomwork.plans.tables import PARAS, WORDS
from loomwork.plans.texts import _loose, _norm
from loomwork.streaming import quota




def fuzzy_quotes(spark, d):
    """A quote of each paragraph: one letter misread, most letters misread, with another number, or in capitals."""
    p = T.paras(spark, d)
    part, case = F.substring("text", 3, 60), (F.col("doc_id") + F.col("idx")) % 4
    misread = F.when(F.length(part) > 12, F.concat(F.substring(part, 1, 11), F.lit("ж"), F.substring(part, 13, 60))).otherwise(part)
    quote = (F.when(case == 0, misread).when(case == 1, F.translate(part, "aeiounrst", "жицулкенг"))
             .when(case == 2, F.concat(part, F.lit(" 987654321"))).otherwise(F.upper(part)))
    return evidence.verified(p.select("doc_id", "pid", quote.alias("quote")), p, ["doc_id", "pid"], fuzzy=True).select("doc_id", "pid", "status")


def unverified_numbers(spark, d):
    i = T.table(spark, d, "lineitem")
    said = F.concat(F.lit("1. Of "), F.format_number("l_partkey", 0), F.lit(" parts, "), F.col("l_quantity").cast("int"), F.lit(" left; see U-0012."))
    known = F.concat(F.lit("Parts: "), F.col("l_partkey"), F.when(F.col("l_linenumber") == 2,
        F.concat(F.lit(" and "), F.col("l_quantity").cast("int"))).otherwise(""), F.lit(", twelve boxes."))
    rows = i.select("l_orderkey", said.alias("said"), known.alias("known"))
    return numbers.unverified_numbers(rows.selectExpr("l_orderkey", "said AS text"), rows.selectExpr("l_orderkey", "known AS text"), "l_orderkey")


def pasted_keys(spark, d):
    c = T.table(spark, d, "customer")
    line = F.concat(F.lit("team"), F.col("c_nationkey"), F.lit(" | "), F.md5("c_name"), F.lit(";\n Bearer "), F.md5("c_mktsegment"),
        F.lit(", API_KEY = \""), F.md5(F.col("c_custkey").cast("string")), F.lit("\""))
    return c.select("c_custkey", F.posexplode(secrets.split_keys(line)).alias("pos", "k")).select("c_custkey", "pos", "k.label",
        secrets.masked(F.col("k.key")).alias("shown"))


def text_forms(spark, d):
    t = F.col("text")
    head = F.concat(F.lit("<p>"), F.regexp_replace(t, r"[^A-Za-z0-9 ]", ""), F.lit("</p><!-- x -->"))
    return T.table(spark, d, "documents").select(
        "doc_id", text.slugify(F.regexp_replace(t, r"[^A-Za-z0-9 ]", ""), 40).alias("slug"), text.without_angles(head).alias("angles"),
        text.without_html(head).alias("bare"),
        F.array_join(text.markdown_problems(F.concat(F.when(F.col("doc_id") % 3 == 0, "## a\n![i](u) ").when(F.col("doc_id") % 3 == 1,
        "[l](u)").otherwise("plain"), F.lit(" text"))), ",").alias("problems"))


def review_order(spark, d):
    p = T.table(spark, d, "part")
    m = p.groupBy(F.col("p_type").alias("source_term")).agg((F.count_distinct("p_brand") > 20).alias("conflict"),
        (F.count("*") % 7 / 10).alias("avg_confidence"), (F.count("*") % 5).alias("docs_count"))
    return glossary.review_order(m).select("source_term", "conflict", "docs_count")


def glossary_release(spark, d):
    p = T.table(spark, d, "part").groupBy(F.col("p_brand").alias("glossary"),
        F.col("p_type").alias("source_term")).agg(F.min("p_name").alias("target_term"), F.min("p_size").alias("n"))
    entries = p.withColumns({"keep_original": F.col("n") % 2 == 0, "status": F.when(F.col("n") % 3 == 0, "suggested").otherwise("confirmed")})
    return glossary.release(entries).select("glossary", "entry_count", "content_sha256")


def entry_evidence(spark, d):
    o = T.table(spark, d, "orders")
    k = F.col("o_orderkey")
    entries = o.select(k.alias("entry"), F.array(k % 50, k % 7, k % 90).alias("ctx_ids"))
    contexts = T.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ctx_id"), F.lit("d").alias("doc"),
        F.col("n_name").alias("snippet"))
    return glossary.with_evidence(entries, contexts).select("entry",
        F.array_join(F.transform("evidence", lambda e: e["snippet"]), ",").alias("snippets"))


def release_gate(spark, d):
    o = T.table(spark, d, "orders")
    both = [o.where(f"o_orderkey % 2 = {k}").groupBy(F.col("o_custkey").alias("suite")).agg(
        (F.count("*") / 20).alias("coverage"), (F.count_if(F.col("o_orderstatus") == "F") / 20).alias("faithfulness"),
        F.round(F.sum("o_totalprice"), 2).alias("cost"),
        F.round(F.max("o_totalprice"), 2).alias("p95")) for k in (0, 1)]
    return reports.release_gate(*both)


def unit_facts(spark, d):
    o = T.table(spark, d, "orders")
    units = o.select(F.col("o_orderkey").alias("unit"), F.when(F.col("o_orderkey") % 3 == 0, "fact_data").otherwise("claim").alias("type"),
        F.lit("s").alias("statement"),
                     F.array(F.col("o_custkey"), F.col("o_orderkey") % 10).alias("numbers"))
    return policies.facts(units)


def merged_cues(spark, d):
    e = T.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"),
        F.concat("event_type", F.when(F.col("event_id") % 3 == 0, ".").otherwise("")).alias("text"))
    m = paragraphs.merged_cues(e, "user_id", 3600.0 * 6)
    return m.groupBy("user_id").agg(F.count("*").alias("cues"), F.sum("parts").alias("parts"), F.max("parts").alias("longest"))


def rolled_captions(spark, d):
    e = T.table(spark, d, "events").select("user_id", F.col("event_id").alias("at"),
        F.substring("event_type", 1, (F.col("event_id") % 4 + 2).cast("int")).alias("text"))
    return paragraphs.rolled_out(e, "user_id").select("user_id", "at")


def term_windows(spark, d):
    p = T.paras(spark, d)
    w = paragraphs.windows(p, size=500, overlap=100)
    per = w.join(p, ["doc_id", "idx"]).groupBy("doc_id", "window").agg(F.count("*").alias("occurrences"))
    best = paragraphs.window_terms(per.withColumn("term", F.lit("any")))
    return w.groupBy("doc_id").agg(F.countDistinct("window").alias("windows"),
        F.count("*").alias("rows")).join(best.select("doc_id", "occurrences", "window"), "doc_id")


def extraction_quality(spark, d):
    p = T.paras(spark, d)
    pages = p.select("doc_id", F.when(F.col("idx") % 5 == 0, F.concat("text", F.lit("��"))).otherwise(F.col("text")).alias("text"),
        (F.col("idx") % 4 == 0).alias("ocr"))
    q = paragraphs.extraction_quality(pages)
    return q.select("doc_id", "median_chars", F.round("printable", 9).alias("printable"), "scanned", F.round("quality", 9).alias("quality"))


def pool_headroom(spark, d):
    i = T.table(spark, d, "lineitem")
    states = i.select(F.col("l_suppkey").alias("deployment"), (F.col("l_quantity") / 40 - 0.1).alias("ratio"))
    h = pool.headroom(states)
    return h.select("deployment", F.round("headroom", 9).alias("headroom"),
        F.round(pool.score(F.col("headroom"), F.lit(0.8), F.col("deployment") % 3), 9).alias("score"))


def least_recent(spark, d):
    c = T.table(spark, d, "customer")
    used = F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal"))
    return pool.least_recent(c.select(F.col("c_nationkey").alias("group_id"), F.col("c_custkey").alias("credential"), used.alias("last_used_at"),
        F.when(F.col("c_custkey") % 3 == 0, "active").otherwise("off").alias("status"))).select("group_id", "credential")


def provider_risks(spark, d):
    s = T.table(spark, d, "supplier")
    tier = F.element_at(F.array(*map(F.lit, ("free", "trial", "paid"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return pool.provider_risks(s.select(F.col("s_suppkey").alias("group_id"), F.col("s_nationkey").alias("provider"), tier.alias("tier")))


def declared_groups(spark, d):
    c = T.table(spark, d, "customer")
    grouping = F.element_at(F.array(*map(F.lit, ("per_key", "by_label", "single_group"))), (F.col("c_nationkey") % 3 + 1).cast("int"))
    keys = c.select(F.col("c_nationkey").alias("declaration"), F.concat(F.lit("p"), F.col("c_nationkey") % 5).alias("provider"),
        grouping.alias("grouping"), F.col("c_mktsegment").alias("label"), F.col("c_custkey").alias("pos"))
    old = T.table(spark, d, "nation").where("n_nationkey < 8").select(F.concat(F.lit("p"), F.col("n_nationkey") % 3, F.lit("-"),
        F.col("n_nationkey")).alias("group_id"))
    return pool.declared_groups(keys, old).select("pos", "group_id")


def probe_scores(spark, d):
    e = T.table(spark, d, "events").select((F.col("user_id") % 20).alias("deployment"), F.col("event_type").alias("kind"),
        (F.col("value") < 80).alias("valid"), F.round("value", 3).alias("latency"))
    return pool.probe_scores(e).select("deployment", "kind", F.round("score", 9).alias("score"), F.round("p50", 6).alias("p50"))


def quota_replay(spark, d):
    """Ten groups with calls of one deployment that only ask for room; five a day are allowed. ``plans.limits`` has the other limits."""
    e = T.table(spark, d, "events").select((F.col("user_id") % 10).cast("string").alias("group"), "event_id",
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    none, null = F.lit(0).cast("long"), F.lit(None)
    rows = e.select("group", F.col("event_id").alias("seq"), "at", F.lit("reserve").alias("kind"), F.lit("x").alias("deployment"),
        null.cast("long").alias("lease"), none.alias("tin"), none.alias("tout"),
                    F.lit(False).alias("low"), null.cast("string").alias("outcome"), null.cast("double").alias("retry_after"),
                    null.cast("double").alias("latency"))
    out = quota.replayed(rows, {"": {"rpd": 6}, "x": {}})
    return out.select("group", "seq", "ok", "lease")


def style_lint(spark, d):
    p = T.table(spark, d, "part")
    k = F.col("p_partkey")
    items = p.select((k % 40).alias("core"), F.element_at(F.array(*map(F.lit, ("rules", "exemplars", "notes"))),
        (k % 3 + 1).cast("int")).alias("kind"), (k % 400).cast("string").alias("id"),
                     F.when(k % 11 == 0, "Ignore all of it").when(k % 13 == 0,
                     F.concat(F.lit("a"), F.char(F.lit(7)))).otherwise(F.col("p_name")).alias("text"),
                     F.when(k % 17 == 0, F.array(F.lit("print"))).otherwise(F.array(F.lit("write"), F.lit("map"))).alias("applies_to"))
    return styles.style_problems(items)


def style_approvals(spark, d):
    o = T.table(spark, d, "orders")
    k = F.col("o_orderkey")
    cores = T.table(spark, d, "customer").select(F.col("c_custkey").alias("core"),
        F.when(F.col("c_custkey") % 9 == 0, " ").otherwise(F.col("c_name")).alias("name"))
    items = o.select(F.col("o_custkey").alias("core"), F.lit("rules").alias("kind"), k.cast("string").alias("id"),
        F.col("o_orderpriority").alias("text"), F.array(F.lit("write")).alias("applies_to"),
                     F.when(k % 2 == 0, "ai").otherwise("human").alias("origin"), (k % 4 == 0).alias("reviewed"))
    decisions = o.select(F.col("o_custkey").alias("core"), k.alias("id"))
    return styles.approval_problems(cores, items, decisions, decisions.where("id % 5 > 0"))


def style_blocks(spark, d):
    p = T.table(spark, d, "part").groupBy((F.col("p_size") % 40).alias("core"), F.col("p_partkey").alias("n")).agg(F.min("p_name").alias("text"))
    severity = F.element_at(F.array(*map(F.lit, ("must", "should", "may"))), (F.col("n") % 3 + 1).cast("int"))
    return reports.style_block(p.select("core", F.format_string("R%05d", "n").alias("rule"), severity.alias("severity"), "text"), 120).select("core",
        F.md5("text").alias("text_md5"))


def approved_versions(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "approved").otherwise("draft").alias("status"),
        F.col("o_orderpriority").alias("content"))
    k = F.col("o_orderkey")
    new = o.where("o_orderkey % 10 <> 0").select("o_orderkey", F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("content")).alias("content"),
        F.when(k % 3 == 0, "draft").when(k % 5 == 0, "deprecated").otherwise(F.col("status")).alias("status"))
    return checks.frozen(o, new, "o_orderkey")


def json_conformance(spark, d):
    e = T.table(spark, d, "events")
    k = F.col("event_id")
    doc = (F.when(k % 6 == 0, '{"k": 1').when(k % 6 == 1, '{"k": "x", "v": 2}').when(k % 6 == 2, '{"v": 2}').when(k % 6 == 3,
        '{"k": 5, "v": -1}').when(k % 6 == 4, '{"k": 5, "v": 1}'))
    return checks.json_problems(e.select("event_id", doc.alias("doc")), "event_id", "doc", "k int, v int", ["k", "v"], {"v_range": F.col("j.v") >= 0})


def cited_places(spark, d):
    p = T.paras(spark, d)
    places = p.select("doc_id", "pid", (F.col("idx") % 9).alias("page"), (F.col("idx") * 1000).alias("timecode"))
    found = p.where("idx % 3 = 0").select(F.concat_ws("/", "doc_id", "pid").alias("unit"), "doc_id",
        F.when(F.col("idx") % 6 == 0, F.lit("P000001")).otherwise(F.col("pid")).alias("pid"))
    cites = p.select(F.col("idx").alias("block"), F.concat_ws("/", "doc_id", "pid").alias("unit"))
    return reports.cited_sources(cites, found, places)


def section_cites(spark, d):
    i = T.table(spark, d, "lineitem")
    own = i.groupBy((F.col("l_suppkey") % 20).alias("section"),
        F.col("l_partkey").alias("unit")).agg(F.when(F.min("l_linenumber") == 1, "core").otherwise("minor").alias("importance"))
    cites = i.where("l_returnflag <> 'R'").select((F.col("l_suppkey") % 20).alias("section"),
        (F.col("l_partkey") + F.when(F.col("l_orderkey") % 31 == 0, 10**7).otherwise(0)).alias("unit"))
    return reports.cite_problems(cites, own)


def spend_upserts(spark, d):
    c = T.calls(spark, d).select("day", F.col("tokens_in").alias("cost"), "call_id")
    return ledger.upsert_spend(c.where("call_id % 3 = 0"), c.where("call_id % 3 > 0"))


def retention(spark, d):
    p = T.paras(spark, d).select("doc_id", "pid")
    k = F.col("doc_id")
    docs = T.table(spark, d, "documents").select("doc_id", F.when(k % 4 > 0, F.timestamp_seconds(k * 1000)).alias("expires_at"),
        F.when(k % 10 == 0, "deleted").otherwise("ready").alias("status"))
    marked, left = queue.purged(docs, p, F.timestamp_seconds(F.lit(400_000)))
    return marked.select("doc_id", "status").join(left.groupBy("doc_id").agg(F.count("*").alias("paragraphs")), "doc_id", "left")


def inserted_once(spark, d):
    c = T.table(spark, d, "customer")
    old, new = c.where("c_custkey % 3 = 0").select("c_mktsegment",
        (F.col("c_custkey") % 500).alias("key")), c.select((F.col("c_custkey") % 700).alias("key"))
    return policies.inserted_once(old, new, "key")[1]


def settings_overlay(spark, d):
    n = T.table(spark, d, "nation")
    parent = n.where("n_nationkey < 20").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("value"))
    child = n.where("n_nationkey > 5").select(F.col("n_name").alias("name"),
        F.when(F.col("n_nationkey") % 3 == 0, "unspecified").when(F.col("n_nationkey") % 3 == 1, "").otherwise("own").alias("value"))
    return reports.overlaid(child, parent)


def number_order(spark, d):
    i = T.table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("number")).distinct()
    return numbers.in_number_order(i)




def _even(x: str, places: int) -> str:
    """Half-even rounding of a double by its decimal digits, as Spark rounds; DuckDB rounds the binary value."""
    d = f"(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,20)) * {10**places})"
    return f"CAST(floor({d}) + CASE WHEN {d} - floor({d}) > 0.5 OR ({d} - floor({d}) = 0.5 AND floor({d}) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / {10**places}"


_T = "words * 20 * CASE lang WHEN 'en' THEN 1.35::DOUBLE WHEN 'vi' THEN 1.6 ELSE 1.4 END"
_EST = ("(VALUES ('full_translation', 2.15::DOUBLE, 0.02::DOUBLE, 1.10::DOUBLE, 1.20::DOUBLE, 1.0::DOUBLE, NULL::DOUBLE, NULL, NULL), ('detailed_synthesis', 4.60, 0.62, 1.30, 1.35, 2.5, 0.35, 1500, 24000), "
        "('deep_synthesis', 4.05, 0.49, 1.30, 1.00, 2.5, 0.12, 800, 9000), ('executive_brief', 3.00, 0.40, 1.30, 0.70, 2.0, 0.03, 250, 1500)) v(level, ix, fx, think, credit, serial, share, low, high)")
_BUDGET = "CASE WHEN share IS NULL THEN words * 20 ELSE CAST(least(high, greatest(low, round_even(CAST(words * 20 * share AS DOUBLE), 0)), greatest(100, floor(words * 20 * 0.8::DOUBLE))) AS BIGINT) END"
_SEGMENTS = f"""{PARAS}, p AS (SELECT doc_id, idx, CAST(ceil(length(text) / 4.0) AS BIGINT) AS t FROM paras),
r AS (SELECT doc_id, idx, 1 AS seg, idx AS a, t FROM p WHERE idx = 1
  UNION ALL SELECT doc_id, idx, CASE WHEN new THEN seg + 1 ELSE seg END, CASE WHEN new THEN idx ELSE a END, CASE WHEN new THEN x ELSE t + x END FROM (
    SELECT p.doc_id, p.idx, r.seg, r.a, r.t, p.t AS x, p.t > 1500 OR (r.t > 1500 AND r.a = r.idx) OR NOT (r.t + p.t <= 400 OR r.t < 150) AS new FROM r JOIN p ON p.doc_id = r.doc_id AND p.idx = r.idx + 1)),
s AS (SELECT doc_id, seg, min(idx) AS f, max(idx) AS l, max(t) AS t, count(*) OVER (PARTITION BY doc_id) AS n FROM r GROUP BY 1, 2),
g AS (SELECT *, max(CASE WHEN seg = n THEN t END) OVER (PARTITION BY doc_id) < 150 AND n > 1 AS short FROM s),
q AS (SELECT doc_id, CASE WHEN short AND seg = n THEN seg - 1 ELSE seg END AS segment, min(f) AS f, max(l) AS l, CAST(sum(t) AS BIGINT) AS t FROM g GROUP BY 1, 2)"""
_CALLS = """least(20, greatest(4, round_even(CAST(budget AS DOUBLE) / 500, 0)))"""


QUERIES = {
    # A letter that the texts do not have is unmatched at any place, so the misread ones tell the similarity.
    "fuzzy_quotes": (fuzzy_quotes, f"""WITH {PARAS},
q AS (SELECT doc_id, pid, text, substr(text, 3, 60) AS part, (doc_id + idx) % 4 AS k FROM paras),
w AS (SELECT *, CASE k WHEN 0 THEN CASE WHEN length(part) > 12 THEN substr(part, 1, 11) || 'ж' || substr(part, 13) ELSE part END WHEN 1 THEN translate(part, 'aeiounrst', 'жицулкенг')
  WHEN 2 THEN part || ' 987654321' ELSE upper(part) END AS quote FROM q),
n AS (SELECT *, {_norm('quote')} AS nq, {_loose('quote')} AS lq, {_norm('text')} AS np, {_loose('text')} AS lp,
  length(part) - length(translate(part, 'aeiounrst', '')) AS changed FROM w)
SELECT doc_id, pid, CASE WHEN nq = '' THEN 'missing' WHEN contains(np, nq) THEN 'exact' WHEN lq <> '' AND contains(lp, lq) THEN 'loose'
  WHEN length(lq) >= 25 AND list_has_all(regexp_extract_all(np, '[0-9]+'), regexp_extract_all(quote, '[0-9]+')) AND (k = 0 OR k = 1 AND changed <= 0.05 * length(lq)) THEN 'fuzzy'
  ELSE 'missing' END AS status FROM n"""),
    "unverified_numbers": (unverified_numbers, """
WITH i AS (SELECT * FROM lineitem),
s AS (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS number FROM i UNION SELECT l_orderkey, CAST(CAST(l_quantity AS INT) AS VARCHAR) FROM i),
k AS (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS number FROM i UNION SELECT l_orderkey, CAST(CAST(l_quantity AS INT) AS VARCHAR) FROM i WHERE l_linenumber = 2 UNION SELECT l_orderkey, '12' FROM i)
SELECT * FROM s EXCEPT SELECT * FROM k"""),
    "pasted_keys": (pasted_keys, """
SELECT c_custkey, pos, label, right(key, 4) AS shown FROM (SELECT c_custkey, 0 AS pos, 'team' || c_nationkey AS label, md5(c_name) AS key FROM customer
UNION ALL SELECT c_custkey, 1, NULL, md5(c_mktsegment) FROM customer UNION ALL SELECT c_custkey, 2, 'API_KEY', md5(CAST(c_custkey AS VARCHAR)) FROM customer)"""),
    "text_forms": (text_forms, """
WITH t AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g') AS t FROM documents)
SELECT doc_id, regexp_replace(substr(trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), '-+$', '') AS slug, '‹p›' || t || '‹/p›‹!-- x --›' AS angles,
  trim(regexp_replace(t, ' +', ' ', 'g'), ' ') AS bare, CASE doc_id % 3 WHEN 0 THEN 'image,heading' WHEN 1 THEN 'link' ELSE '' END AS problems FROM t"""),
    "review_order": (review_order, """
WITH m AS (SELECT p_type AS source_term, count(DISTINCT p_brand) > 20 AS conflict, (count(*) % 7) / 10 AS c, count(*) % 5 AS docs_count FROM part GROUP BY 1)
SELECT source_term, conflict, docs_count FROM m ORDER BY conflict DESC, c, docs_count DESC, lower(source_term)"""),
    "glossary_release": (glossary_release, r"""
WITH p AS (SELECT p_brand AS glossary, p_type AS s, min(p_name) AS t, min(p_size) AS n FROM part GROUP BY 1, 2),
e AS (SELECT glossary, lower(s) AS o, '{"source_term":"' || s || '","target_term":"' || t || '","keep_original":' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS j FROM p WHERE n % 3 > 0)
SELECT glossary, CAST(count(*) AS INT) AS entry_count, sha256(string_agg(j, chr(10) ORDER BY o, j)) AS content_sha256 FROM e GROUP BY 1"""),
    "entry_evidence": (entry_evidence, """
WITH c AS (SELECT o_orderkey AS entry, unnest([o_orderkey % 50, o_orderkey % 7, o_orderkey % 90]) AS ctx, unnest([0, 1, 2]) AS pos FROM orders),
s AS (SELECT entry, string_agg(n_name, ',' ORDER BY pos) AS snippets FROM c JOIN nation ON n_nationkey = ctx GROUP BY 1) SELECT o_orderkey AS entry, coalesce(snippets, '') AS snippets FROM orders LEFT JOIN s ON entry = o_orderkey"""),
    "release_gate": (release_gate, """
WITH g AS (SELECT o_custkey AS suite, o_orderkey % 2 AS h, count(*) / 20 AS c, count(*) FILTER (o_orderstatus = 'F') / 20 AS f, round(sum(o_totalprice), 2) AS cost, round(max(o_totalprice), 2) AS p95 FROM orders GROUP BY 1, 2),
b AS (SELECT n.suite, unnest([CASE WHEN o.c - n.c > 0.03::DOUBLE THEN 'coverage' END, CASE WHEN o.f - n.f > 0.02::DOUBLE THEN 'faithfulness' END, CASE WHEN n.cost > o.cost * 1.2::DOUBLE THEN 'cost' END,
  CASE WHEN n.p95 > o.p95 * 1.3::DOUBLE THEN 'p95' END]) AS problem FROM g n JOIN g o ON o.suite = n.suite AND o.h = 0 AND n.h = 1) SELECT * FROM b WHERE problem IS NOT NULL"""),
    "unit_facts": (unit_facts, "SELECT o_orderkey AS unit, 's' AS statement, unnest([o_custkey, o_orderkey % 10]) AS number FROM orders WHERE o_orderkey % 3 = 0"),
    "merged_cues": (merged_cues, """
WITH e AS (SELECT user_id, ts, event_id % 3 = 0 AS stop FROM events),
b AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) > 21600 OR lag(stop) OVER w THEN 1 ELSE 0 END AS brk FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
c AS (SELECT user_id, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS cue FROM b), n AS (SELECT user_id, cue, count(*) AS parts FROM c GROUP BY 1, 2)
SELECT user_id, count(*) AS cues, CAST(sum(parts) AS BIGINT) AS parts, max(parts) AS longest FROM n GROUP BY 1"""),
    "rolled_captions": (rolled_captions, """
WITH e AS (SELECT user_id, event_id AS at_, substr(event_type, 1, event_id % 4 + 2) AS t FROM events), n AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY at_) AS nx FROM e)
SELECT user_id, at_ AS "at" FROM n WHERE nx IS NULL OR NOT starts_with(nx, t)"""),
    "term_windows": (term_windows, f"""
WITH {PARAS}, a AS (SELECT doc_id, idx, coalesce(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tm FROM paras),
w AS (SELECT doc_id, idx, unnest(range(CASE WHEN tm >= 500 THEN CAST((tm - 500) // 400 AS BIGINT) + 1 ELSE 0 END, CAST(tm // 400 AS BIGINT) + 1)) + 1 AS win FROM a),
n AS (SELECT doc_id, win, count(*) AS c FROM w GROUP BY 1, 2)
SELECT doc_id, count(*) AS windows, CAST(sum(c) AS BIGINT) AS rows, max(c) AS occurrences, arg_min(win, -c * 1000000 + win) AS "window" FROM n GROUP BY 1"""),
    "extraction_quality": (extraction_quality, f"""
WITH {PARAS}, p AS (SELECT doc_id, length(text) + CASE WHEN idx % 5 = 0 THEN 2 ELSE 0 END AS n, length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0e-\\x1f\\x{{FFFD}}]', '', 'g')) + CASE WHEN idx % 5 = 0 THEN 2 ELSE 0 END AS odd, idx % 4 = 0 AS ocr FROM paras),
q AS (SELECT doc_id, median(n) AS median_chars, 1 - sum(odd) / greatest(sum(n), 1) AS printable, avg(CASE WHEN n >= 200 THEN 1 ELSE 0 END) AS l, avg(CASE WHEN ocr THEN 1 ELSE 0 END) AS o FROM p GROUP BY 1)
SELECT doc_id, median_chars, round(printable, 9) AS printable, median_chars < 200 AS scanned, round(0.5::DOUBLE * printable + 0.3::DOUBLE * l + 0.2::DOUBLE * (1 - o), 9) AS quality FROM q"""),
    "pool_headroom": (pool_headroom, """
WITH h AS (SELECT l_suppkey AS deployment, greatest(0.0::DOUBLE, least(1.0::DOUBLE, min(l_quantity / 40 - 0.1::DOUBLE))) AS h FROM lineitem GROUP BY 1)
SELECT deployment, round(h, 9) AS headroom, round(h * (0.8::DOUBLE * 0.5 + 0.5) * (deployment % 3), 9) AS score FROM h"""),
    "least_recent": (least_recent, """
SELECT c_nationkey AS group_id, c_custkey AS credential FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END ASC NULLS FIRST, c_custkey) AS n FROM customer WHERE c_custkey % 3 = 0) WHERE n = 1"""),
    "provider_risks": (provider_risks, """
WITH s AS (SELECT s_suppkey AS group_id, s_nationkey AS provider, ['free', 'trial', 'paid'][CAST(s_suppkey % 3 + 1 AS INT)] AS tier FROM supplier)
SELECT *, tier IN ('free', 'trial') AND same >= 2 AS multi_account_risk FROM (SELECT *, count(*) OVER (PARTITION BY provider, tier) AS same FROM s)"""),
    "declared_groups": (declared_groups, """
WITH k AS (SELECT c_nationkey AS decl, 'p' || (c_nationkey % 5) AS provider, c_custkey AS pos, CASE c_nationkey % 3 WHEN 0 THEN 'k' || c_custkey WHEN 1 THEN 'l' || c_mktsegment ELSE 'all' END AS unit FROM customer),
f AS (SELECT provider, decl, unit, min(pos) AS first FROM k GROUP BY 1, 2, 3),
l AS (SELECT 'p' || (n_nationkey % 3) AS provider, max(n_nationkey) AS last FROM nation WHERE n_nationkey < 8 GROUP BY 1),
n AS (SELECT f.*, coalesce(last, 0) + row_number() OVER (PARTITION BY f.provider ORDER BY decl, first) AS n FROM f LEFT JOIN l ON l.provider = f.provider)
SELECT pos, provider || '-' || n AS group_id FROM k JOIN n USING (provider, decl, unit)"""),
    "probe_scores": (probe_scores, """SELECT user_id % 20 AS deployment, event_type AS kind, round(avg(CASE WHEN value < 80 THEN 1 ELSE 0 END), 9) AS score, round(median(round(value, 3)), 6) AS p50 FROM events GROUP BY 1, 2"""),
    "quota_replay": (quota_replay, """
WITH e AS (SELECT CAST(user_id % 10 AS VARCHAR) AS "group", event_id AS seq, CAST(ts AS DATE) AS day FROM events),
n AS (SELECT *, max(day) OVER (PARTITION BY "group" ORDER BY seq) = day AND row_number() OVER (PARTITION BY "group", day ORDER BY seq) <= 5 AS ok FROM e)
SELECT "group", seq, ok, CASE WHEN ok THEN count(*) FILTER (ok) OVER (PARTITION BY "group" ORDER BY seq) END AS lease FROM n"""),
    "style_lint": (style_lint, """
WITH p AS (SELECT p_partkey AS k, p_partkey % 40 AS core, ['rules', 'exemplars', 'notes'][CAST(p_partkey % 3 + 1 AS INT)] AS kind, p_partkey % 400 AS id FROM part)
SELECT core, kind || '[' || id || ']' AS path, 'repeated_id' AS problem FROM p WHERE kind <> 'notes' GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT core, kind || '[' || id || ']', 'unknown_stage' FROM p WHERE k % 17 = 0 UNION ALL SELECT core, kind || '[' || id || ']', 'control_character' FROM p WHERE k % 13 = 0 AND k % 11 > 0
UNION ALL SELECT core, kind || '[' || id || ']', 'steers_prompt' FROM p WHERE k % 11 = 0 AND kind <> 'exemplars'"""),
    "style_approvals": (style_approvals, """
SELECT core, problem, count(*) AS n FROM (SELECT o_custkey AS core, 'open_decision' AS problem FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_custkey, 'unreviewed' FROM orders WHERE o_orderkey % 4 = 2
UNION ALL SELECT c_custkey, 'no_name' FROM customer WHERE c_custkey % 9 = 0) GROUP BY 1, 2"""),
    "style_blocks": (style_blocks, """
WITH r AS (SELECT p_size % 40 AS core, p_partkey % 3 AS s, printf('- [R%05d] %s', p_partkey, trim(translate(p_name, '<>', '‹›'), ' ')) AS l, p_partkey AS n FROM part),
t AS (SELECT core, string_agg(l, chr(10) ORDER BY s, n) AS t3, string_agg(l, chr(10) ORDER BY s, n) FILTER (s < 2) AS t2, coalesce(string_agg(l, chr(10) ORDER BY s, n) FILTER (s < 1), '') AS t1 FROM r GROUP BY 1)
SELECT core, md5(CASE WHEN length(t3) <= 120 THEN t3 WHEN length(coalesce(t2, '')) <= 120 THEN coalesce(t2, '') ELSE t1 END) AS text_md5 FROM t"""),
    "approved_versions": (approved_versions, """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'deleted' WHEN o_orderkey % 7 = 0 THEN 'content_changed' ELSE 'bad_status' END AS problem FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey % 10 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 3 = 0)"""),
    "json_conformance": (json_conformance, """
SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'missing_k' WHEN 3 THEN 'v_range' ELSE 'unreadable' END AS problem FROM events WHERE event_id % 6 <> 4"""),
    "cited_places": (cited_places, f"""
WITH {PARAS} SELECT CAST(c.idx AS INT) AS block, c.doc_id || '/' || c.pid AS unit, c.doc_id, p.pid, CAST(p.idx % 9 AS INT) AS page, CAST(p.idx * 1000 AS INT) AS timecode
FROM paras c JOIN paras p ON p.doc_id = c.doc_id AND p.idx = CASE WHEN c.idx % 6 = 0 THEN 1 ELSE c.idx END WHERE c.idx % 3 = 0"""),
    "section_cites": (section_cites, """
WITH o AS (SELECT l_suppkey % 20 AS section, l_partkey AS unit, min(l_linenumber) = 1 AS core FROM lineitem GROUP BY 1, 2),
c AS (SELECT DISTINCT l_suppkey % 20 AS section, l_partkey + CASE WHEN l_orderkey % 31 = 0 THEN 10000000 ELSE 0 END AS unit FROM lineitem WHERE l_returnflag <> 'R')
SELECT section, unit, 'not_in_section' AS problem FROM c ANTI JOIN o USING (section, unit) UNION ALL SELECT section, unit, 'core_uncited' FROM o ANTI JOIN c USING (section, unit) WHERE core"""),
    "spend_upserts": (spend_upserts, "SELECT CAST(ts AS DATE) AS day, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS cost FROM events GROUP BY 1"),
    "retention": (retention, f"""
WITH {PARAS}, d AS (SELECT doc_id, doc_id % 4 > 0 AND doc_id < 400 AND doc_id % 10 > 0 AS gone FROM documents), c AS (SELECT doc_id, count(*) AS n FROM paras GROUP BY 1)
SELECT d.doc_id, CASE WHEN gone OR d.doc_id % 10 = 0 THEN 'deleted' ELSE 'ready' END AS status, CASE WHEN NOT gone THEN n END AS paragraphs FROM d LEFT JOIN c ON c.doc_id = d.doc_id"""),
    "inserted_once": (inserted_once, """
WITH n AS (SELECT c_custkey % 700 AS k FROM customer), f AS (SELECT DISTINCT k FROM n WHERE k NOT IN (SELECT c_custkey % 500 FROM customer WHERE c_custkey % 3 = 0))
SELECT (SELECT count(*) FROM f) AS inserted, (SELECT count(*) FROM n) - (SELECT count(*) FROM f) AS skipped"""),
    "settings_overlay": (settings_overlay, """
WITH c AS (SELECT n_name, 'own' AS v FROM nation WHERE n_nationkey > 5 AND n_nationkey % 3 = 2), p AS (SELECT n_name, CAST(n_regionkey AS VARCHAR) AS v FROM nation WHERE n_nationkey < 20)
SELECT coalesce(c.n_name, p.n_name) AS name, coalesce(c.v, p.v) AS value FROM p FULL JOIN c ON c.n_name = p.n_name"""),
    "number_order": (number_order, "SELECT number FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS number FROM lineitem) ORDER BY length(number), number"),
}

#: SQL of queries that are defined elsewhere.
SQL = {
    "segments": f"WITH RECURSIVE {_SEGMENTS} SELECT doc_id, CAST(segment AS INT) AS segment, CAST(f AS INT) AS first_idx, CAST(l AS INT) AS last_idx, t AS tokens FROM q",
    "segment_context": f"""WITH RECURSIVE {_SEGMENTS}
SELECT doc_id, CAST(segment AS INT) AS segment, CASE WHEN f > 2 THEN printf('P%06d,P%06d', f - 2, f - 1) WHEN f = 2 THEN 'P000001' ELSE '' END AS context FROM q""",
    "cost_estimates": f"""WITH {WORDS}, e AS (SELECT *, {_T} AS t, {_BUDGET} AS budget FROM words, {_EST}),
x AS (SELECT *, ix * t AS tin, think * (fx * t + budget * 1.8::DOUBLE) AS tout, greatest(1, ceil(t / 300000)) AS g, {_CALLS} AS sec FROM e),
m AS (SELECT *, serial + tout * 2.0::DOUBLE / 43200.0::DOUBLE AS minutes FROM x)
SELECT doc_id, level, CAST({_even('tin', 0)} AS BIGINT) AS tokens_in, CAST({_even('tout', 0)} AS BIGINT) AS tokens_out, {_even('tin / 1e6 * 0.3::DOUBLE + tout / 1e6 * 2.5::DOUBLE', 4)} AS cost_usd,
  CAST(greatest(1, ceil(words * 20 / 300 * credit)) AS BIGINT) AS credits, {_even('minutes * 0.7::DOUBLE', 1)} AS minutes_low, {_even('minutes * 1.8::DOUBLE', 1)} AS minutes_high,
  CAST(CASE WHEN level = 'full_translation' THEN ceil(1 + g + ceil(t / 4000) * 1.1::DOUBLE) ELSE ceil(1 + g + ceil(t / 8000) * 1.1::DOUBLE + 1 + sec + (ceil(sec) + ceil(sec * 0.5::DOUBLE)) + sec * 0.6::DOUBLE + 1) END AS BIGINT) AS calls FROM m""",
    "translation_modes": f"""WITH {WORDS}, e AS (SELECT *, {_T} AS t, words * 20 * 1.8::DOUBLE AS v FROM words, (VALUES ('direct'), ('postedit_full'), ('postedit_selective')) m(mode)),
x AS (SELECT *, t * 2.15::DOUBLE + CASE WHEN mode = 'direct' THEN 0 ELSE v END AS tin,
  (t * 0.02::DOUBLE + CASE WHEN mode = 'postedit_selective' THEN v * (1 - 0.7::DOUBLE) + words * 20 / 60 * 0.7::DOUBLE * 14 ELSE v END) * 1.1::DOUBLE AS tout FROM e)
SELECT doc_id, mode, CAST({_even('tin', 0)} AS BIGINT) AS tokens_in, CAST({_even('tout', 0)} AS BIGINT) AS tokens_out, {_even('tin / 1e6 * 0.3::DOUBLE + tout / 1e6 * 2.5::DOUBLE', 4)} AS cost_usd,
  CAST(ceil(greatest(1, ceil(t / 4000)) * 1.1::DOUBLE) AS BIGINT) AS llm_calls FROM x""",
    "day_capacity_forecast": f"""WITH {WORDS}, e AS (SELECT doc_id, {_T} AS t FROM words)
SELECT doc_id, CAST(floor(237.0::DOUBLE / ceil(1 + greatest(1, ceil(t / 300000)) + ceil(t / 4000) * 1.1::DOUBLE)) AS BIGINT) AS per_day FROM e""",
    "block_checks": f"""WITH {PARAS}, b AS (SELECT text || CASE idx % 6 WHEN 0 THEN ' U-00012 ' WHEN 1 THEN ' <b>x</b> ' WHEN 2 THEN ' Certainly, ' ELSE '' END AS t FROM paras),
l AS (SELECT t, regexp_replace(t, '[^\\p{{L}}]+', '', 'g') AS l FROM b),
x AS (SELECT unnest([CASE WHEN regexp_matches(t, '\\b(?:U-\\d{{4,}}|P\\d{{6,}}|SEG-\\d{{3,}})\\b') THEN 'leaked_id' END,
  CASE WHEN regexp_matches(t, '(?i)\\bas an ai\\b|\\bi cannot\\b|\\bhere is the\\b|\\bcertainly[,!]') THEN 'assistant_phrase' END, CASE WHEN regexp_matches(t, '(?i)</?[a-z][^>]*>|https?://') THEN 'markup' END,
  CASE WHEN length(t) > 200 AND CASE WHEN length(l) > 0 THEN length(regexp_replace(l, '[A-Za-z]+', '', 'g')) / length(l) ELSE 0 END < 0.12::DOUBLE THEN 'few_diacritics' END]) AS problem FROM l)
SELECT problem, count(*) AS n FROM x WHERE problem IS NOT NULL GROUP BY 1""",
}
