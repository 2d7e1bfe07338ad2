import pandas as pd
import pytest
from loomwork.streaming import quota, windows
from pyspark.sql import functions as F

LIMITS = {"": {"rpm": 100, "tpd": 100_000}, "d": {"rpm": 2, "tpm": 1000, "rpd": 4, "concurrency": 2}}
BASE = {"group": "g", "deployment": "d", "lease": 0, "tin": 10, "tout": 10, "low": False, "outcome": None, "retry_after": None, "latency": None}


def events(*steps):
    return [BASE | {"seq": i, "at": at, "kind": kind} | more for i, (at, kind, more) in enumerate(steps)]


def run(*steps, limits=LIMITS):
    q = quota.Quota(limits)
    return q, [q.step(e) for e in events(*steps)]


def test_buckets_refill_and_deny():
    q, got = run((0.0, "reserve", {}), (0.0, "reserve", {}), (60.0, "reserve", {}))
    assert got[0][:2] == (True, 1) and got[1][0] is False and got[1][3] == "deployment_rpm" and got[2][0] is True
    assert abs(got[1][2] - (2 - 1.7) / (1.7 / 60)) < 1e-6 or got[1][2] > 0


def test_too_large_and_concurrency():
    wide = {"": {}, "d": {"tpm": 1000, "concurrency": 1}}
    _, got = run((0.0, "reserve", {"tin": 900}), (0.0, "reserve", {}), (0.0, "reserve", {}), limits=wide)
    assert got[0][3] == "too_large" and got[1][0] and got[2][2:] == (1.0, "deployment_concurrency")


def test_circuit_opens_and_closes_again():
    free = {"": {}, "d": {}}
    steps = []
    for i in range(3):
        steps += [(float(i), "reserve", {}), (float(i), "settle", {"lease": i + 1, "outcome": "server_error"})]
    q, got = run(*steps, (3.0, "reserve", {}), (17.5, "reserve", {}), (17.6, "reserve", {}), (18.0, "settle", {"lease": 4, "outcome": "ok"}),
        (18.1, "reserve", {}), limits=free)
    assert got[6][0] is False and got[6][3] == "deployment_cooldown" and got[7][0] is True and got[8][3] == "probing" and got[10][0] is True
    assert q.s["scopes"]["d"]["circuit"] == "closed"


def test_rate_limits_back_off_and_late_settlements_do_nothing():
    free = {"": {}, "d": {"rpm": 600}}
    q, got = run((0.0, "reserve", {}), (1.0, "settle", {"lease": 1, "outcome": "rate_limited_unknown"}),
        (1.0, "settle", {"lease": 1, "outcome": "ok"}), (2.0, "reserve", {}), limits=free)
    assert got[2][3] == "no_lease" and got[3][3] == "deployment_cooldown" and abs(got[3][2] - 29) < 1e-9 and abs(q.s["scopes"]["d"]["scale"] - 0.85) < 1e-9


def test_reaping_frees_the_place_but_not_the_tokens():
    one = {"": {}, "d": {"concurrency": 1, "tpd": 1000}}
    q, got = run((0.0, "reserve", {}), (301.0, "reap", {}), (301.0, "reserve", {}), limits=one)
    assert got[1][2] == 1.0 and got[2][0] is True and q.s["scopes"]["d"]["tpd"] == 40


def test_days_turn_over_by_zone():
    daily = {"": {}, "d": {"rpd": 1}}
    q = quota.Quota(daily, "America/Los_Angeles")
    first = q.reserve("d", 1790000000.0, 1, 1, False)
    second = q.reserve("d", 1790000001.0, 1, 1, False)
    assert first[0] and second[3] == "deployment_rpd" and second[2] == 1790060400.0 - 1790000001.0
    assert q.reserve("d", 1790060400.0, 1, 1, False)[0]


@pytest.fixture
def log():
    steps = [(float(i * 7), "reserve", {}) for i in range(12)] + [(90.0, "settle", {"lease": 1, "outcome": "ok", "latency": 5.0}),
        (400.0, "reap", {}), (401.0, "reserve", {"low": True})]
    return events(*steps) + [e | {"group": "h"} for e in events(*steps)]


def frame(spark, rows):
    names = [x.split()[0] for x in quota.EVENT.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], quota.EVENT)


def test_stream_answers_as_the_batch_does(spark, log, tmp_path):
    batch = sorted(map(tuple, quota.replayed(frame(spark, log), LIMITS).collect()), key=str)
    for part in range(3):
        frame(spark, [e for e in log if e["seq"] % 15 // 5 == part]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(quota.EVENT).parquet(f"{tmp_path}/in")
        out = quota.decided(stream, LIMITS).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation",
            f"{tmp_path}/check").trigger(availableNow=True).start()
        out.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str) == batch and len(batch) == 30


def test_windows_on_a_stream(spark, tmp_path):
    rows = pd.DataFrame({"ts": pd.to_datetime(["2026-01-01 00:10", "2026-01-01 00:20", "2026-01-01 05:00"]), "status": [429, 200, 200]})
    spark.createDataFrame(rows, "ts timestamp, status int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, status int").parquet(f"{tmp_path}/in")
    done = windows.rolling_rates(stream, "1 hour", "1 hour", "10 minutes").writeStream.format("memory").queryName("rates").outputMode("append").start()
    done.processAllAvailable()
    done.stop()
    assert [(r.n, r.limited) for r in spark.table("rates").collect()] == [(2, 1)]


def test_tail_goes_on_after_a_restart(spark, tmp_path):
    for k in range(2):
        spark.range(3 * k, 3 * k + 3).withColumn("e", F.lit("x")).write.mode("append").parquet(f"{tmp_path}/log")
        query = windows.tail(spark, f"{tmp_path}/log", "id long, e string", f"{tmp_path}/out", f"{tmp_path}/at")
        query.awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(3 * k + 3))
