"""Queries on ledgers, prices, queues and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import ledger as L
from loomwork.operators import pool, queue, reports
from loomwork.plans import tables as T
from loomwork.plans.tables import CALLS, COST, JOBS, LEDGER, PRICED, PRICES_SQL, TASKS
from loomwork.streaming import windows

NOW = "2024-01-20 00:00:00"


def credit_balance(spark, d):
    users = T.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return L.balances(T.ledger(spark, d), users)


def v_credit_balance(spark, d):
    return L.balances(T.ledger(spark, d))


def running_balance(spark, d):
    return L.running_balance(T.ledger(spark, d)).select("user_id", "entry_id", "balance")


def charge_credits(spark, d):
    e = T.table(spark, d, "events")
    opening = e.groupBy("user_id").agg((F.count("*") * 100).alias("balance"))
    requests = e.select("user_id", F.col("event_id").alias("seq"), F.floor("value").cast("long").alias("amount"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("k"), (F.col("event_id") % 100).cast("string"))).alias("idem"))
    return L.charges(requests, opening)


def refund_credits(spark, d):
    e = T.table(spark, d, "events")
    rows = e.select((F.col("user_id")).alias("job_id"), F.when(F.col("event_type") == "purchase", "job_charge").when(F.col("event_type") == "click",
        "job_refund").otherwise("grant").alias("reason"),
                    F.when(F.col("event_type") == "purchase", -F.floor("value")).otherwise(F.floor(F.col("value") / 10)).cast("long").alias("delta"))
    # A sum of doubles depends on the order of its rows, and the floor of one that should be whole with it.
    ask = e.groupBy(F.col("user_id").alias("job_id")).agg(F.floor(F.sum(F.col("value").cast("decimal(20,6)")) / 8).cast("long").alias("amount"))
    return L.refunds(ask, rows).select("job_id", "amount", F.col("refund").cast("long").alias("refund"))


def redeem_invites(spark, d):
    e = T.table(spark, d, "events")
    codes = spark.range(40).select(F.format_string("CODE%02d", "id").alias("code"), (F.col("id") % 5 + 1).cast("int").alias("max_uses"),
        F.lit(100).alias("credits"),
                                   F.when(F.col("id") % 4 == 0, F.to_timestamp_ntz(F.lit(NOW))).alias("expires_at"),
                                   (F.col("id") % 11 == 0).alias("revoked"))
    attempts = e.select(F.col("event_id").alias("attempt_id"), F.format_string("code%02d", F.col("event_id") % 45).alias("code"), "user_id",
        F.col("ts").alias("at"))
    return L.redeemed(attempts, codes).select("attempt_id", "code", "status")


def call_costs(spark, d):
    return L.priced(T.calls(spark, d), T.prices(spark)).select("call_id", "model", "effective_from", L.cost_usd().cast("double").alias("cost_usd"))


def daily_spend(spark, d):
    rows = L.priced(T.calls(spark, d), T.prices(spark)).select("day", "at", F.col("call_id").alias("cost_id"), L.cost_usd().alias("cost"))
    return L.daily_spend(rows, 0.5).select("day", "cost_id", F.col("spent").cast("double").alias("spent"), "paused")


def spend_abuse(spark, d):
    rows = T.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), F.floor("value").cast("long").alias("cost"))
    return L.abuse(rows, 3.0).select("user_id", F.unix_seconds("at").alias("at_s"), "spent_24h")


def claim_tasks(spark, d):
    return queue.claimed(T.tasks(spark, d), T.jobs(spark, d), F.lit("1997-01-01").cast("timestamp"), 60, 2).select("task_id", "job_id")


def reclaim_tasks(spark, d):
    return queue.reclaimed(T.tasks(spark, d), F.lit("1996-06-01").cast("timestamp"), "30 days").groupBy("status",
        "error_code").agg(F.count("*").alias("n"))


def job_progress(spark, d):
    rows = T.tasks(spark, d).groupBy("job_id").agg(F.count_if(F.col("status") == "done").alias("done"), F.count("*").alias("total"))
    stage = F.element_at(F.array(*map(F.lit, queue.SYNTHESIS_WEIGHTS)), (F.col("job_id") % 10 + 1).cast("int"))
    return queue.progress(rows.withColumn("stage", stage))


def first_requests(spark, d):
    e = T.table(spark, d, "events").select(F.col("event_id").alias("request_id"), "user_id", F.col("ts").alias("at"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("idem"))
    return queue.first_requests(e).select("request_id", "user_id")


def usage_daily(spark, d):
    grade = F.when(F.col("cost") > 200_000, "A").when(F.col("cost") > 100_000, "B").otherwise("C")
    return reports.usage(T.jobs(spark, d).withColumn("grade", grade).withColumn("cost", F.floor("cost").cast("long")))


def latency_percentiles(spark, d):
    e = T.table(spark, d, "events")
    return e.groupBy("event_type").agg(F.expr("percentile(value, 0.5)").alias("p50"), F.expr("percentile(value, 0.95)").alias("p95"),
        F.avg((F.col("value") > 100).cast("int")).alias("slow_rate"))


def ewma_success(spark, d):
    e = T.table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") != "purchase").cast("int").alias("ok"))
    return pool.smoothed(e, "user_id", "ok", "event_id").select("user_id", F.round("ewma", 6).alias("ewma"), "n")


def privacy_audit(spark, d):
    jobs = T.jobs(spark, d)
    groups = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("group_id"),
        F.when(F.col("n_regionkey") == 1, "no_training").when(F.col("n_regionkey") == 2, "may_train").alias("data_policy"))
    calls = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_suppkey") % 25).cast("int").alias("group_id"),
        F.col("l_linenumber").alias("call"))
    return pool.privacy_breaches(jobs, calls, groups).groupBy("group_id").agg(F.count("*").alias("calls"))


def rolling_rates(spark, d):
    e = T.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "purchase", 429).otherwise(200).alias("status"))
    return windows.rolling_rates(e, "1 day", "6 hours").select(F.unix_seconds("start").alias("start_s"), "n", "limited")


def request_limits(spark, d):
    e = T.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return windows.over_limit(e, "user_id", 1, "1 day").select("user_id", F.unix_seconds("start").alias("start_s"), "n")


def cue_sessions(spark, d):
    e = T.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return windows.sessions(e, "user_id", "12 hours").select("user_id", F.unix_seconds("start").alias("start_s"), "n")


def event_replay(spark, d):
    return queue.after_event(T.table(spark, d, "events"), 200, 100).select("event_id", "event_type")


QUERIES = {
    "credit_balance": (credit_balance, f"WITH {LEDGER} SELECT c_custkey AS user_id, CAST(coalesce(sum(delta), 0) AS BIGINT) AS balance FROM customer LEFT JOIN ledger ON user_id = c_custkey GROUP BY 1"),
    "v_credit_balance": (v_credit_balance, f"WITH {LEDGER} SELECT user_id, CAST(sum(delta) AS BIGINT) AS balance FROM ledger GROUP BY 1"),
    "running_balance": (running_balance, f"WITH {LEDGER} SELECT user_id, entry_id, CAST(sum(delta) OVER (PARTITION BY user_id ORDER BY tm, entry_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM ledger"),
    "charge_credits": (charge_credits, """
WITH RECURSIVE r AS (
  SELECT user_id, event_id AS seq, CAST(floor(value) AS BIGINT) AS amount, CASE WHEN event_id % 4 = 0 THEN 'k' || (event_id % 100) END AS idem,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT *, idem IS NOT NULL AND row_number() OVER (PARTITION BY user_id, idem ORDER BY seq) > 1 AS again FROM r),
o AS (SELECT user_id, count(*) * 100 AS balance FROM events GROUP BY 1),
f AS (
  SELECT o.user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS amount, false AS accepted, CAST(o.balance AS BIGINT) AS balance FROM o
  UNION ALL
  SELECT s.user_id, s.n, s.seq, s.amount, s.again OR (s.amount > 0 AND s.amount <= f.balance),
         CASE WHEN s.again OR s.amount <= 0 OR s.amount > f.balance THEN f.balance ELSE f.balance - s.amount END
  FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1)
SELECT user_id, seq, amount, accepted, balance FROM f WHERE n > 0"""),
    "refund_credits": (refund_credits, """
WITH l AS (SELECT user_id AS job_id, CASE event_type WHEN 'purchase' THEN 'job_charge' WHEN 'click' THEN 'job_refund' ELSE 'grant' END AS reason,
  CAST(CASE WHEN event_type = 'purchase' THEN -floor(value) ELSE floor(value / 10) END AS BIGINT) AS delta FROM events),
a AS (SELECT user_id AS job_id, CAST(floor(sum(value) / 8) AS BIGINT) AS amount FROM events GROUP BY 1),
s AS (SELECT job_id, -sum(delta) AS open FROM l WHERE reason IN ('job_charge', 'job_refund') GROUP BY 1)
SELECT a.job_id, a.amount, CAST(greatest(0, least(a.amount, coalesce(s.open, 0))) AS BIGINT) AS refund FROM a LEFT JOIN s USING (job_id)"""),
    "redeem_invites": (redeem_invites, f"""
WITH c AS (SELECT printf('CODE%02d', i) AS code, i % 5 + 1 AS max_uses, CASE WHEN i % 4 = 0 THEN TIMESTAMP '{NOW}' END AS expires_at, i % 11 = 0 AS revoked FROM range(40) t(i)),
a AS (SELECT event_id AS attempt_id, upper(printf('code%02d', event_id % 45)) AS code, user_id, ts AS tm FROM events),
v AS (SELECT a.*, c.max_uses, c.max_uses IS NOT NULL AND NOT c.revoked AND (c.expires_at IS NULL OR c.expires_at >= a.tm) AS valid FROM a LEFT JOIN c USING (code)),
f AS (SELECT *, valid AND row_number() OVER (PARTITION BY code, user_id, valid ORDER BY tm, attempt_id) = 1 AS first FROM v),
k AS (SELECT *, row_number() OVER (PARTITION BY code, first ORDER BY tm, attempt_id) AS n FROM f)
SELECT attempt_id, code, CASE WHEN NOT valid THEN 'invalid' WHEN NOT first THEN 'repeated' WHEN n > max_uses THEN 'exhausted' ELSE 'ok' END AS status FROM k"""),
    "call_costs": (call_costs, f"WITH {CALLS}, {PRICES_SQL}, {PRICED} SELECT call_id, model, effective_from, CAST({COST} AS DOUBLE) AS cost_usd FROM priced"),
    "daily_spend": (daily_spend, f"""WITH {CALLS}, {PRICES_SQL}, {PRICED}, s AS (SELECT day, call_id AS cost_id,
  sum({COST}) OVER (PARTITION BY day ORDER BY tm, call_id ROWS UNBOUNDED PRECEDING) AS spent FROM priced) SELECT day, cost_id, CAST(spent AS DOUBLE) AS spent, spent >= 0.5 AS paused FROM s"""),
    "spend_abuse": (spend_abuse, """
WITH w AS (SELECT user_id, epoch_s AS at_s, CAST(sum(cost) OVER (PARTITION BY user_id ORDER BY epoch_s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS BIGINT) AS spent_24h
  FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s, CAST(floor(value) AS BIGINT) AS cost FROM events))
SELECT * FROM w WHERE spent_24h > 3.0 * (SELECT avg(spent_24h) FROM w)"""),
    "claim_tasks": (claim_tasks, f"""WITH {JOBS}, {TASKS},
h AS (SELECT t.* FROM tasks t JOIN jobs j ON j.job_id = t.job_id AND j.status = 'running' AND NOT j.cancel_requested
  WHERE t.status = 'pending' AND run_after <= TIMESTAMP '1997-01-01' ORDER BY created_at, task_id LIMIT 500),
b AS (SELECT job_id, count(*) AS busy FROM tasks WHERE status = 'running' GROUP BY 1),
r AS (SELECT h.task_id, h.job_id, h.created_at, coalesce(busy, 0) AS busy, row_number() OVER (PARTITION BY h.job_id ORDER BY created_at, task_id) AS own FROM h LEFT JOIN b ON b.job_id = h.job_id)
SELECT task_id, job_id FROM r WHERE own <= 2 - busy ORDER BY created_at, task_id LIMIT 60"""),
    "reclaim_tasks": (reclaim_tasks, f"""WITH {TASKS}, l AS (SELECT *, status = 'running' AND heartbeat_at < TIMESTAMP '1996-06-01' - INTERVAL 30 DAY AS lost FROM tasks)
SELECT CASE WHEN lost AND attempt >= max_attempts THEN 'failed' WHEN lost THEN 'pending' ELSE status END AS status, CASE WHEN lost THEN 'lease_expired' END AS error_code, count(*) AS n FROM l GROUP BY 1, 2"""),
    "job_progress": (job_progress, f"""WITH {TASKS}, s AS (SELECT job_id, [5, 2, 1, 6, 30, 8, 25, 15, 5, 3][CAST(job_id % 10 + 1 AS INT)] AS w, count(*) FILTER (status = 'done') AS done, count(*) AS total FROM tasks GROUP BY 1, 2)
SELECT job_id, round(w * done / total, 2) AS pct FROM s"""),
    "first_requests": (first_requests, """WITH r AS (SELECT event_id AS request_id, user_id, CASE WHEN event_type <> 'view' THEN event_type END AS idem, ts FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, idem ORDER BY ts, request_id) AS n FROM r) SELECT request_id, user_id FROM n WHERE n = 1 OR idem IS NULL"""),
    "usage_daily": (usage_daily, f"""WITH {JOBS}, g AS (SELECT *, CASE WHEN cost > 200000 THEN 'A' WHEN cost > 100000 THEN 'B' ELSE 'C' END AS grade FROM jobs)
SELECT day, count(*) AS jobs, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, CAST(sum(CAST(floor(cost) AS BIGINT)) AS BIGINT) AS cost,
  count(*) FILTER (grade = 'A') AS grade_a, count(*) FILTER (grade = 'B') AS grade_b, count(*) FILTER (grade = 'C') AS grade_c FROM g GROUP BY 1"""),
    "latency_percentiles": (latency_percentiles, "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, avg(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS slow_rate FROM events GROUP BY 1"),
    "ewma_success": (ewma_success, """
WITH v AS (SELECT user_id, list(CASE WHEN event_type <> 'purchase' THEN 1.0 ELSE 0.0 END ORDER BY event_id) AS vs FROM events GROUP BY 1)
SELECT user_id, round(list_reduce(list_prepend(1.0::DOUBLE, list_transform(vs, lambda x: x::DOUBLE)), lambda a, x: 0.9::DOUBLE * a + (1 - 0.9::DOUBLE) * x), 6) AS ewma, CAST(len(vs) AS INT) AS n FROM v"""),
    "privacy_audit": (privacy_audit, f"""WITH {JOBS}, g AS (SELECT n_nationkey AS group_id, CASE n_regionkey WHEN 1 THEN 'no_training' WHEN 2 THEN 'may_train' END AS data_policy FROM nation)
SELECT g.group_id, count(*) AS calls FROM lineitem l JOIN jobs j ON j.job_id = l.l_orderkey AND j.privacy = 'private' JOIN g ON g.group_id = l.l_suppkey % 25
WHERE g.data_policy IS DISTINCT FROM 'no_training' GROUP BY 1"""),
    "rolling_rates": (rolling_rates, """
WITH e AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS s, event_type FROM events), w AS (SELECT (s // 21600 - k) * 21600 AS start_s, event_type FROM e, range(4) t(k))
SELECT start_s, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS limited FROM w GROUP BY 1"""),
    "request_limits": (request_limits, "SELECT user_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start_s, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1"),
    "cue_sessions": (cue_sessions, """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER o < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n FROM s GROUP BY user_id, k"""),
    "event_replay": (event_replay, "SELECT event_id, event_type FROM events WHERE event_id > 200 ORDER BY event_id LIMIT 100"),
}
