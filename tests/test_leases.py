"""Leases on a stream: timers, credentials, and the same answers however the stream is cut; and the batch operators by hand."""

import pytest
from loomwork.operators import limits
from loomwork.streaming import leases, quota
from pyspark.sql import functions as F

T0 = 1_790_000_000.0
LIMITS = {"g": {"": {"concurrency": 3}, "d": {"rpm": 600, "concurrency": 3}}, "h": {"": {}, "d": {}}}
KEYS = {"g": ["k1", "k2"], "h": ["k3"]}
BASE = {"deployment": "d", "lease": None, "tin": 1, "tout": 1, "low": False, "outcome": None, "retry_after": None, "latency": None, "scope": None}


def log(group, *steps):
    return [BASE | {"group": group, "seq": i, "at": T0 + at, "kind": kind} | more for i, (at, kind, more) in enumerate(steps)]


STEPS = (
    (0, "reserve", {}), (1, "reserve", {}), (2, "settle", {"lease": 1, "outcome": "ok"}), (3, "settle", {"lease": 1, "outcome": "ok"}),
    (10, "reserve", {}), (20, "reserve", {}), (21, "reserve", {}), (310, "reserve", {}), (311, "settle", {"lease": 2, "outcome": "ok"}),
    (312, "settle", {"lease": 5, "outcome": "auth_error"}), (313, "reserve", {}), (314, "settle", {"lease": 6, "outcome": "auth_error"}), (2000, "reserve", {}))
ROWS = log("g", *STEPS) + log("h", (5, "reserve", {}), (9, "settle", {"lease": 1, "outcome": "auth_error"}), (12, "reserve", {}))
SCHEMA = quota.EVENT + ", scope string"


def frame(spark, rows):
    return spark.createDataFrame([tuple(float(r[n]) if n == "at" else r[n] for n in leases.names(SCHEMA)) for r in rows], SCHEMA)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(leases.STORE)
    spark.conf.set(leases.STORE, leases.ROCKS)
    yield
    spark.conf.set(leases.STORE, before)


def streamed(spark, tmp_path, cuts):
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, 10**9])):
        frame(spark, [r for r in ROWS if a <= r["at"] - T0 < b]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        out = leases.leased(stream, LIMITS, KEYS).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        out.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out").collect()


@pytest.mark.parametrize("cuts", [(), (15,), (2.5, 311.5, 400)])
def test_answers_and_timers(spark, rocks, tmp_path, cuts):
    rows = streamed(spark, tmp_path, cuts)
    answers = {r.seq: r for r in rows if r.group == "g" and r.kind != "expire"}
    assert [answers[i].ok for i in range(13)] == [True, True, True, False, True, True, False, True, False, True, True, True, False]
    assert answers[3].reason == answers[8].reason == "no_lease"  # repeated, and after its time
    assert answers[6].reason == "group_concurrency" and answers[6].wait == 1.0
    assert [answers[i].credential for i in (0, 1, 4, 5, 7)] == ["k1", "k2", "k1", "k2", "k1"]
    assert answers[10].credential == "k2"  # k1 is quarantined
    assert answers[12].reason == "no_credential" and answers[12].wait == float("inf")
    # leases 2, 3 and 4 are never settled in time; each ends once, by an event or a timer
    assert sorted(r.lease for r in rows if r.kind == "expire" and r.group == "g") == [2, 3, 4]
    assert [r.reason for r in rows if r.group == "h" and r.seq == 2] == ["no_credential"]


def test_a_timer_ends_leases_of_a_silent_group(spark, rocks, tmp_path):
    first = log("g", (0, "reserve", {}))
    for part in (first, log("h", (1000, "reserve", {})), log("h", (1001, "reserve", {}))):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        leases.leased(stream, LIMITS, KEYS).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
            "checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    gone = [(r.group, r.lease) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.kind == "expire"]
    assert ("g", 1) in gone


def test_rate_limits_hit_the_scope_they_name():
    q = quota.Quota({"": {}, "d": {}})
    q.reserve("d", T0, 1, 1, False)
    q.settle(1, T0, "rate_limited_minute", 1, 1, 40.0, None, "group")
    assert q.s["scopes"][""]["cool"] == T0 + 40 and q.s["scopes"]["d"]["cool"] == 0.0
    assert q.reserve("d", T0 + 1, 1, 1, False)[3] == "group_cooldown"


def test_levels_do_not_depend_on_slices(spark):
    rows = [("s", i, float(i * 5 % 97 + i), float(i % 7 * 20), float(i % 5 - 2) * 15) for i in range(200)] + [("t", 0, 5000.0, 10.0, 0.0)]
    events = spark.createDataFrame(rows, "scope string, seq long, at double, spent double, back double")
    caps = spark.createDataFrame([("s", 120.0), ("t", 60.0)], "scope string, cap double")
    want, level, last = {}, 120.0, None
    for _, seq, at, spent, back in sorted((r for r in rows if r[0] == "s"), key=lambda r: (r[2], r[1])):
        level = level if last is None else min(120.0, level + 2 * (at - last))
        before, last = level, at
        level -= spent
        level = max(0.0, min(120.0, level + back)) if back else level
        want[seq] = (before, level)
    for width in (7, 50, 100_000):
        got = {r.seq: (r.before, r.after) for r in limits.token_levels(events, caps, width).where("scope = 's'").collect()}
        assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k]))


def test_streaks_over_slices(spark):
    kinds = "ok server_error timeout canceled network_error ok timeout timeout".split()
    calls = spark.createDataFrame([("d", i, float(i * 100), k) for i, k in enumerate(kinds)], "deployment string, seq long, at double, outcome string")
    for width in (100, 250, 10_000):
        rows = limits.failure_streaks(calls, 3, width)
        assert sorted((r.seq, r.streak, r.opens) for r in rows.collect()) == [(1, 1, False), (2, 2, False), (4, 3, True), (6, 1, False), (7, 2, False)]
        assert sorted(r.length for r in limits.streaks(rows).collect()) == [2, 3]


def test_as_of_reads_the_latest_state(spark):
    states = spark.createDataFrame([("a", 0.0, 1, 1), ("a", 50.0, 2, 2), ("a", 50.0, 3, 3), ("b", 10.0, 4, 4)], "k string, at double, seq long, v int")
    events = spark.createDataFrame([("a", 0.0), ("a", 49.9), ("a", 50.0), ("a", 5000.0), ("b", 9.0), ("c", 1.0)], "k string, at double")
    for width in (1, 60, 10_000):
        got = {(r.k, r.at): r.v for r in limits.as_of(events, states, "k", ["v"], width).collect()}
        assert got == {("a", 0.0): 1, ("a", 49.9): 1, ("a", 50.0): 3, ("a", 5000.0): 3, ("b", 9.0): None, ("c", 1.0): None}


def test_ties_keep_the_group(spark):
    at = {"at": 100.0}
    groups = spark.createDataFrame([("g", 0.0, 1, 160.0, 0, 9)], "group string, at double, seq long, cool double, running int, most int")
    own = spark.createDataFrame([("d", 0.0, 1, 160.0, 0, 9), ("e", 0.0, 2, 170.0, 9, 9), ("f", 0.0, 3, 0.0, 9, 9)], "deployment string, at double, seq long, cool double, running int, most int")
    requests = spark.createDataFrame([(1, "g", "d", at["at"]), (2, "g", "e", 100.0), (3, "x", "f", 100.0), (4, "x", "y", 1.0)], "seq long, group string, deployment string, at double")
    got = {r.seq: (r.wait, r.reason) for r in limits.scope_waits(requests, groups, own).collect()}
    assert got == {1: (60.0, "group_cooldown"), 2: (70.0, "deployment_cooldown"), 3: (1.0, "deployment_concurrency"), 4: (0.0, "")}


def test_no_rows(spark):
    none = spark.createDataFrame([], "deployment string, seq long, at double, outcome string")
    assert limits.failure_streaks(none).count() == 0
    assert limits.carried(limits.sliced(none), ["deployment"], ["at"], F.lit(1), "n").count() == 0
