"""Queries on the decisions of document jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import estimates
from loomwork.operators import policies, reports
from loomwork.plans import tables as T
from loomwork.plans.tables import PARAS, WORDS


def jobs_admitted(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("profile"),
        F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 9 + 1).alias("calls"))
    cap = o.groupBy("profile").agg((F.count("*") * 2).alias("calls_left"))
    return policies.admitted_jobs(o, cap).select("job_id", "needed", "admitted")


def job_cost_caps(spark, d):
    i = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"),
        F.col("l_linenumber").alias("cost_id")).agg(F.min("l_shipdate").alias("at"), F.floor(F.min("l_extendedprice")).cast("long").alias("cost"))
    est = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.floor(F.col("o_totalprice") / 4).cast("long").alias("estimate"))
    return policies.over_cost(i, est)


def job_daily_limit(spark, d):
    e = T.table(spark, d, "events").select(F.col("event_id").alias("job_id"), "user_id", F.to_date("ts").alias("day"), F.col("ts").alias("at"))
    return policies.daily_limit(e, 2).select("job_id", "allowed")


def alert_metrics(spark, d):
    e = T.table(spark, d, "events")
    metrics = e.groupBy(F.col("event_type").alias("metric")).agg((F.count_if(F.col("value") > 50) * 1000 / F.count("*")).cast("long").alias("value"))
    limits = e.select(F.col("event_type").alias("metric")).distinct().select("metric", F.lit(450).alias("limit"),
        (F.length("metric") > 4).alias("above"))
    return policies.alerts(metrics, limits)


def refunds_due(spark, d):
    o = T.table(spark, d, "orders")
    event = F.element_at(F.array(*map(F.lit, ["succeeded", "failed", "canceled_early", "canceled_late", "grade_c", "job_cost_cap"])),
        (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = o.select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 400).alias("charged"), event.alias("event"),
        ((F.col("o_orderkey") % 4) / 4).alias("progress"))
    return policies.refund_due(rows).select("job_id", "refund")


def glossary_gates(spark, d):
    w = T.words(spark, d).select("doc_id", "words", (F.col("doc_id") % 10 / 10).alias("confidence"))
    return policies.glossary_gate(w, F.col("words") * 10).select("doc_id", "status")


def rerun_work(spark, d):
    i = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("segment"), F.lit(1).alias("first_idx"),
        (F.col("o_orderkey") % 9 + 1).cast("int").alias("last_idx"),
                                           (F.col("o_custkey") % 10 / 10).alias("bad_ratio"), (F.col("o_orderkey") % 5 == 0).alias("truncated"),
                                           (F.col("o_custkey") % 3).alias("runs"))
    return policies.reruns(i)


def unit_density(spark, d):
    p = T.paras(spark, d)
    u = p.select("doc_id", F.when(F.col("idx") % 3 == 0, "core").otherwise("minor").alias("importance"), (F.col("idx") % 15 != 0).alias("verified"))
    r = policies.unit_stats(u, T.words(spark, d).select("doc_id", "words"))
    return r.select("doc_id", "units", "core", F.round("density", 6).alias("density"), F.round("unverified_core", 6).alias("unverified_core"),
        "flagged")


def topics(spark, d):
    p = T.paras(spark, d)
    u = p.select(F.when(F.col("idx") % 2 == 0, "core").otherwise("minor").alias("importance"),
        F.array(F.lower(F.regexp_extract("text", r"^([A-Za-z]+)", 1))).alias("topics"))
    return policies.top_topics(u, 10)


def segment_texts(spark, d):
    return policies.segment_text(T.paras(spark, d), "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


def section_bullets(spark, d):
    p = T.paras(spark, d).select(F.col("doc_id").alias("section"), F.col("idx").alias("pos"), F.col("text").alias("statement"))
    return reports.bullets(p).select("section", F.md5("text").alias("text_md5"))


def profile_samples(spark, d):
    parts = policies.profile_sample(F.col("text"), 0.05, 15_000)
    return T.table(spark, d, "documents").select("doc_id", F.size(parts).alias("parts"), F.md5(F.array_join(parts, "|")).alias("sample_md5"))


def translation_modes(spark, d):
    modes = spark.createDataFrame([("direct",), ("postedit_full",), ("postedit_selective",)], "mode string")
    w = T.words(spark, d).crossJoin(F.broadcast(modes))
    e = estimates.estimate_translation(F.col("words") * 20, F.col("mode"), F.col("lang"), F.lit(0.3), F.lit(2.5))
    return w.select("doc_id", "mode", F.inline(F.array(e)))


def day_capacity_forecast(spark, d):
    w = T.words(spark, d)
    calls = estimates.estimate_calls(F.col("words") * 20, F.lit("full_translation"), F.col("lang"))
    return w.select("doc_id", F.floor(estimates.docs_per_day(F.lit(237.0), F.lit(None).cast("double"), calls,
        F.lit(1))).cast("long").alias("per_day"))


def retry_waits(spark, d):
    k = F.col("event_id") % 9 + 1
    return T.table(spark, d, "events").select("event_id", estimates.backoff(30.0, k).alias("rate_wait"),
        estimates.backoff(15.0, k).alias("trip_wait"), F.least(F.pow(F.lit(2.0), k) * 5, F.lit(300.0)).alias("task_wait"))


def new_ids(spark, d):
    old = T.table(spark, d, "nation").select(F.concat(F.lit("g-"), F.col("n_nationkey")).alias("id"))
    return policies.numbered_after(old, T.table(spark, d, "region").select("r_name"), "g", "r_name")


def merged_config(spark, d):
    n = T.table(spark, d, "nation")
    a, b = n.where("n_nationkey % 2 = 0").select("n_nationkey", F.lit("a").alias("from_list")), n.where("n_nationkey % 3 = 0").select("n_nationkey",
        F.lit("b").alias("from_list"))
    return policies.merged_by_id(a, b, "n_nationkey")


def cloned_deployments(spark, d):
    n = T.table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("group_id"),
        F.concat(F.lit("x-"), F.lower("n_name")).alias("deployment"))
    g = T.table(spark, d, "region").select(F.concat(F.lit("new"), F.col("r_regionkey")).alias("group_id"),
        F.col("r_regionkey").cast("string").alias("source"))
    return policies.cloned(n, g)


QUERIES = {
    "jobs_admitted": (jobs_admitted, """
WITH o AS (SELECT o_orderkey AS job_id, o_orderpriority AS p, o_orderdate AS tm, o_orderkey % 9 + 1 AS calls FROM orders), c AS (SELECT p, count(*) * 2 AS cap FROM o GROUP BY 1),
r AS (SELECT job_id, p, CAST(sum(calls) OVER (PARTITION BY p ORDER BY tm, job_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS needed FROM o) SELECT job_id, needed, needed <= cap AS admitted FROM r JOIN c USING (p)"""),
    "job_cost_caps": (job_cost_caps, """
WITH i AS (SELECT l_orderkey AS job_id, l_linenumber AS cost_id, min(l_shipdate) AS tm, CAST(floor(min(l_extendedprice)) AS BIGINT) AS cost FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, sum(cost) OVER (PARTITION BY job_id ORDER BY tm, cost_id ROWS UNBOUNDED PRECEDING) AS spent FROM i),
x AS (SELECT s.job_id, cost_id, row_number() OVER (PARTITION BY s.job_id ORDER BY tm, cost_id) AS n FROM s JOIN orders ON o_orderkey = s.job_id WHERE spent > floor(o_totalprice / 4) * 1.5)
SELECT job_id, cost_id FROM x WHERE n = 1"""),
    "job_daily_limit": (job_daily_limit, "SELECT event_id AS job_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 AS allowed FROM events"),
    "alert_metrics": (alert_metrics, """WITH m AS (SELECT event_type AS metric, count(*) FILTER (value > 50) * 1000 // count(*) AS value FROM events GROUP BY 1)
SELECT metric, value FROM m WHERE CASE WHEN length(metric) > 4 THEN value > 450 ELSE value < 450 END"""),
    "refunds_due": (refunds_due, """SELECT o_orderkey AS job_id, CAST(floor((o_custkey % 400) * CASE o_orderkey % 6 WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1.0 WHEN 3 THEN 0.5 WHEN 4 THEN 0.5 WHEN 5 THEN 1 - (o_orderkey % 4) / 4 ELSE 0 END) AS BIGINT) AS refund FROM orders"""),
    "glossary_gates": (glossary_gates, f"WITH {WORDS} SELECT doc_id, CASE WHEN words * 10 < 2000 THEN 'skipped' WHEN (doc_id % 10) / 10 >= 0.7::DOUBLE THEN 'confirmed' ELSE 'rejected' END AS status FROM words"),
    "rerun_work": (rerun_work, """
WITH s AS (SELECT o_orderkey AS segment, 1 AS f, CAST(o_orderkey % 9 + 1 AS INT) AS l, (o_custkey % 10) / 10 AS bad, o_orderkey % 5 = 0 AS cut, o_custkey % 3 AS runs FROM orders)
SELECT segment, 'half' AS action, f AS a, (f + l) // 2 AS b FROM s WHERE cut AND f < l UNION ALL SELECT segment, 'half', (f + l) // 2 + 1, l FROM s WHERE cut AND f < l
UNION ALL SELECT segment, 'rerun', f, l FROM s WHERE NOT (cut AND f < l) AND bad > 0.3::DOUBLE AND runs < 2"""),
    "unit_density": (unit_density, f"""WITH {PARAS}, {WORDS}, u AS (SELECT doc_id, count(*) AS units, count(*) FILTER (idx % 3 = 0) AS core, count(*) FILTER (idx % 3 = 0 AND idx % 15 = 0) AS bad FROM paras GROUP BY 1)
SELECT doc_id, units, core, round(units * 1000 / words, 6) AS density, round(CASE WHEN core > 0 THEN bad / core ELSE 0 END, 6) AS unverified_core, CASE WHEN core > 0 THEN bad / core ELSE 0 END >= 0.03 AS flagged FROM u JOIN words USING (doc_id)"""),
    "topics": (topics, f"WITH {PARAS} SELECT lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS topic, count(*) AS core FROM paras WHERE idx % 2 = 0 GROUP BY 1 ORDER BY core DESC, topic LIMIT 10"),
    "segment_texts": (segment_texts, f"WITH {PARAS} SELECT doc_id, md5(string_agg('[' || pid || '] ' || text, chr(10) || chr(10) ORDER BY idx)) AS text_md5 FROM paras GROUP BY 1"),
    "section_bullets": (section_bullets, f"WITH {PARAS} SELECT doc_id AS section, md5(string_agg('- ' || text, chr(10) ORDER BY idx)) AS text_md5 FROM paras GROUP BY 1"),
    "profile_samples": (profile_samples, """
WITH p AS (SELECT doc_id, CASE WHEN length(text) < 750 THEN [text] ELSE [substr(text, 1, 300), substr(text, CAST(floor(length(text) * 0.4::DOUBLE) AS BIGINT) - 50, 100), substr(text, CAST(floor(length(text) * 0.55::DOUBLE) AS BIGINT) - 50, 100),
  substr(text, CAST(floor(length(text) * 0.7::DOUBLE) AS BIGINT) - 50, 100), right(text, 100)] END AS ps FROM documents) SELECT doc_id, CAST(len(ps) AS INT) AS parts, md5(array_to_string(ps, '|')) AS sample_md5 FROM p"""),
    "translation_modes": (translation_modes, None),
    "day_capacity_forecast": (day_capacity_forecast, None),
    "retry_waits": (retry_waits, "SELECT event_id, least(600.0::DOUBLE, 30 * pow(2, event_id % 9)) AS rate_wait, least(600.0::DOUBLE, 15 * pow(2, event_id % 9)) AS trip_wait, least(5 * pow(2, event_id % 9 + 1), 300.0::DOUBLE) AS task_wait FROM events"),
    "new_ids": (new_ids, "SELECT r_name, 'g-' || (24 + row_number() OVER (ORDER BY r_name)) AS id FROM region"),
    "merged_config": (merged_config, "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS from_list FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0"),
    "cloned_deployments": (cloned_deployments, "SELECT 'new' || n_regionkey AS group_id, 'new' || n_regionkey || '-' || lower(n_name) AS deployment FROM nation"),
}
