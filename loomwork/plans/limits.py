"""Queries on limits: leases, credentials, token buckets, circuits, and the waits of both scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import limits
from loomwork.plans import tables as T

OUTCOMES = ("ok", "ok", "server_error", "timeout", "ok", "auth_error", "canceled")


def _log(spark, d):
    """Events as calls of groups and deployments; a third of them are of one group."""
    e = T.table(spark, d, "events")
    group = F.when(F.col("user_id") % 3 == 0, "hot").otherwise((F.col("user_id") % 7).cast("string"))
    outcome = F.element_at(F.array(*map(F.lit, OUTCOMES)), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("seq"), group.alias("group"), F.concat_ws("/", group, F.col("user_id") % 2).alias("deployment"),
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"), F.floor("value").cast("long").alias("tokens"), "event_type", outcome.alias("outcome"))


LOG = f"""log AS (
  SELECT event_id AS seq, g AS "group", g || '/' || (user_id % 2) AS deployment, CAST(floor(epoch(ts)) AS DOUBLE) AS tm, CAST(floor(value) AS BIGINT) AS tokens, event_type,
         [{', '.join(f"'{o}'" for o in OUTCOMES)}][event_id % 7 + 1] AS outcome
  FROM (SELECT *, CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE CAST(user_id % 7 AS VARCHAR) END AS g FROM events))"""


def _leases(spark, d):
    """Calls as leases, and their settlements: some too late, some twice, some of no lease."""
    log = _log(spark, d)
    leases = log.select("group", F.col("seq").alias("lease"), "at", (F.col("seq") % 3).cast("string").alias("credential"))
    ends = log.select("group", F.when(F.col("seq") % 13 == 0, -F.col("seq")).otherwise(F.col("seq")).alias("lease"),
                      (F.col("at") + F.col("seq") % 8 * 50).alias("at"), "seq", "outcome")
    again = ends.where("seq % 11 = 0").select("group", "lease", (F.col("at") + 1).alias("at"), (F.col("seq") + 10**9).alias("seq"), "outcome")
    return leases, ends.unionByName(again)


LEASES = LOG + """,
leases AS (SELECT "group", seq AS lease, tm, CAST(seq % 3 AS VARCHAR) AS credential FROM log),
ends0 AS (SELECT "group", CASE WHEN seq % 13 = 0 THEN -seq ELSE seq END AS lease, tm + seq % 8 * 50 AS tm, seq, outcome FROM log),
ends AS (SELECT * FROM ends0 UNION ALL SELECT "group", lease, tm + 1, seq + 1000000000, outcome FROM ends0 WHERE seq % 11 = 0),
judged AS (
  SELECT e.*, l.tm AS begun, coalesce(e.tm >= l.tm AND e.tm < l.tm + 300, false) AS timely
  FROM ends e LEFT JOIN leases l ON l."group" = e."group" AND l.lease = e.lease),
settled AS (
  SELECT *, timely AND row_number() OVER (PARTITION BY "group", lease, timely ORDER BY tm, seq) = 1 AS accepted FROM judged),
ended AS (
  SELECT l."group", l.lease, l.tm, l.credential, coalesce(s.tm, l.tm + 300) AS ended_at, CASE WHEN s.tm IS NULL THEN 'expired' ELSE 'settled' END AS how, s.outcome
  FROM leases l LEFT JOIN (SELECT * FROM settled WHERE accepted) s ON s."group" = l."group" AND s.lease = l.lease)"""


def lease_settlements(spark, d):
    leases, ends = _leases(spark, d)
    return limits.settlements(leases, ends).select("group", "seq", "accepted", "reason")


def lease_ends(spark, d):
    """Each lease with its end and how many of its group's ran when it began."""
    leases, ends = _leases(spark, d)
    ended = limits.lease_ends(leases, ends)
    return ended.join(limits.in_flight(ended).select("group", "lease", "running"), ["group", "lease"]).select("group", "lease", "ended_at", "how", "outcome", "running")


def credential_states(spark, d):
    """Three credentials a group; a request asks half a minute after each call."""
    leases, ends = _leases(spark, d)
    log = _log(spark, d)
    ended = limits.lease_ends(leases, ends.where("seq % 5 = 0 OR outcome <> 'auth_error'"))
    keys = log.select("group").distinct().withColumn("credential", F.explode(F.array(*map(F.lit, "012"))))
    return limits.credential_states(log.select("group", "seq", (F.col("at") + 30).alias("at")), keys, ended).select("group", "seq", "active", "reason")


def token_levels(spark, d):
    """Calls take their tokens, errors charge and signups give back half of theirs; time runs a thousand times faster."""
    log = _log(spark, d)
    tokens, kind = F.col("tokens").cast("double"), F.col("event_type")
    events = log.select(F.col("group").alias("scope"), "seq", (F.col("at") / 1024).alias("at"), F.when(kind.isin("error", "signup"), 0.0).otherwise(tokens).alias("spent"),
                        F.when(kind == "error", -tokens / 2).when(kind == "signup", tokens / 2).otherwise(0.0).alias("back"))
    caps = log.groupBy(F.col("group").alias("scope")).agg(F.lit(3840.0).alias("cap"))
    return limits.token_levels(events, caps, 64).select("scope", "seq", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


def failure_streaks(spark, d):
    calls = _log(spark, d).select("deployment", "seq", "at", "outcome")
    return limits.failure_streaks(calls, 2, 86_400).select("deployment", "seq", "streak", "opens")


def streak_lengths(spark, d):
    calls = _log(spark, d).select("deployment", "seq", "at", "outcome")
    return limits.streaks(limits.failure_streaks(calls, 2, 86_400)).select("deployment", "island", "length", "first_at", "last_at")


def scope_waits(spark, d):
    """Errors set a group's state and clicks a deployment's; every other event asks."""
    log = _log(spark, d)
    state = {"cool": F.col("at") + F.col("tokens") * 40, "running": F.col("seq") % 5, "most": F.lit(4)}
    groups = log.where("event_type = 'error'").select("group", "at", "seq", *(c.alias(n) for n, c in state.items()))
    deployments = log.where("event_type = 'click'").select("deployment", "at", "seq", *(c.alias(n) for n, c in state.items()))
    requests = log.where("event_type NOT IN ('error', 'click')").select("seq", "group", "deployment", (F.col("at") + 1).alias("at"))
    return limits.scope_waits(requests, groups, deployments, 86_400).select("seq", "wait", "reason")


QUERIES = {
    "lease_settlements": (lease_settlements, f"""WITH {LEASES}
SELECT "group", seq, accepted, CASE WHEN accepted THEN outcome WHEN begun IS NULL THEN 'unknown' WHEN timely THEN 'repeated' ELSE 'late' END AS reason FROM settled"""),
    "lease_ends": (lease_ends, f"""WITH {LEASES},
steps AS (SELECT "group", lease, tm, 1 AS d FROM ended UNION ALL SELECT "group", lease, ended_at, -1 FROM ended),
run AS (SELECT *, CAST(sum(d) OVER (PARTITION BY "group" ORDER BY tm, d, lease ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM steps)
SELECT e."group", e.lease, e.ended_at, e.how, e.outcome, r.running FROM ended e JOIN run r ON r.d = 1 AND r."group" = e."group" AND r.lease = e.lease"""),
    "credential_states": (credential_states, f"""WITH {LEASES.replace("settled AS (", "settled AS (", 1).replace("FROM judged)", "FROM judged WHERE seq % 5 = 0 OR outcome <> 'auth_error')")},
lost AS (SELECT "group", credential, min(ended_at) AS lost_at FROM ended WHERE outcome = 'auth_error' GROUP BY ALL),
n AS (SELECT l."group", l.seq, CAST(3 - count(x.credential) AS BIGINT) AS active
      FROM log l LEFT JOIN lost x ON x."group" = l."group" AND x.lost_at <= l.tm + 30 GROUP BY l."group", l.seq)
SELECT "group", seq, active, CASE WHEN active = 0 THEN 'no_credential' END AS reason FROM n"""),
    "token_levels": (token_levels, f"""WITH RECURSIVE {LOG},
e AS (SELECT "group" AS scope, seq, tm / 1024 AS tm, CASE WHEN event_type IN ('error', 'signup') THEN 0.0 ELSE CAST(tokens AS DOUBLE) END AS spent,
        CASE event_type WHEN 'error' THEN -tokens / 2.0 WHEN 'signup' THEN tokens / 2.0 ELSE 0.0 END AS back,
        row_number() OVER (PARTITION BY "group" ORDER BY tm, seq) AS n FROM log),
r AS (
  SELECT scope, seq, n, tm, CAST(3840.0 AS DOUBLE) AS before, CASE WHEN back <> 0 THEN greatest(0.0, least(3840.0, 3840.0 - spent + back)) ELSE 3840.0 - spent END AS after
  FROM e WHERE n = 1
  UNION ALL
  SELECT scope, seq, n, tm, level, CASE WHEN back <> 0 THEN greatest(0.0, least(3840.0, level - spent + back)) ELSE level - spent END
  FROM (SELECT e.scope, e.seq, e.n, e.tm, e.spent, e.back, least(3840.0, r.after + 64.0 * (e.tm - r.tm)) AS level FROM r JOIN e ON e.scope = r.scope AND e.n = r.n + 1))
SELECT scope, seq, round(before, 6) AS before, round(after, 6) AS after FROM r"""),
    "failure_streaks": (failure_streaks, f"""WITH {LOG},
c AS (SELECT deployment, seq, tm, outcome = 'ok' AS ok FROM log WHERE outcome IN ('ok', 'server_error', 'timeout', 'network_error')),
i AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY deployment ORDER BY tm, seq ROWS UNBOUNDED PRECEDING) AS island FROM c),
s AS (SELECT deployment, seq, row_number() OVER (PARTITION BY deployment, island ORDER BY tm, seq) AS streak FROM i WHERE NOT ok)
SELECT deployment, seq, streak, streak = 2 AS opens FROM s"""),
    "streak_lengths": (streak_lengths, f"""WITH {LOG},
c AS (SELECT deployment, seq, tm, outcome = 'ok' AS ok FROM log WHERE outcome IN ('ok', 'server_error', 'timeout', 'network_error')),
i AS (SELECT *, CAST(sum(CAST(ok AS INT)) OVER (PARTITION BY deployment ORDER BY tm, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM c)
SELECT deployment, island, count(*) AS length, min(tm) AS first_at, max(tm) AS last_at FROM i WHERE NOT ok GROUP BY deployment, island"""),
    "scope_waits": (scope_waits, f"""WITH {LOG},
st AS (SELECT *, tm + tokens * 40 AS cool, seq % 5 AS running FROM log),
q AS (SELECT seq, "group", deployment, tm + 1 AS tm FROM log WHERE event_type NOT IN ('error', 'click')),
g AS (SELECT q.seq, arg_max(s.cool, [s.tm, s.seq]) AS cool, arg_max(s.running, [s.tm, s.seq]) AS running
      FROM q JOIN st s ON s.event_type = 'error' AND s."group" = q."group" AND s.tm <= q.tm GROUP BY q.seq),
p AS (SELECT q.seq, arg_max(s.cool, [s.tm, s.seq]) AS cool, arg_max(s.running, [s.tm, s.seq]) AS running
      FROM q JOIN st s ON s.event_type = 'click' AND s.deployment = q.deployment AND s.tm <= q.tm GROUP BY q.seq),
w AS (SELECT seq, g.cool - tm AS wait, 0 AS nth, 'group_cooldown' AS reason FROM q JOIN g USING (seq) WHERE g.cool > tm
      UNION ALL SELECT seq, p.cool - tm, 1, 'deployment_cooldown' FROM q JOIN p USING (seq) WHERE p.cool > tm
      UNION ALL SELECT seq, 1.0, 2, 'group_concurrency' FROM g WHERE running >= 4
      UNION ALL SELECT seq, 1.0, 3, 'deployment_concurrency' FROM p WHERE running >= 4),
b AS (SELECT seq, wait, reason, row_number() OVER (PARTITION BY seq ORDER BY wait DESC, nth) AS r FROM w)
SELECT q.seq, coalesce(b.wait, 0.0) AS wait, coalesce(b.reason, '') AS reason FROM q LEFT JOIN b ON b.seq = q.seq AND b.r = 1"""),
}
