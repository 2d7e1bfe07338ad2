import datetime as dt
import math

import pytest
from loomwork.functions import clock, estimates, http
from loomwork.operators import checks, glossary, ledger, paragraphs, pool, queue, reports
from loomwork.plans import accounts
from pyspark.sql import functions as F


def test_credit_life(spark):
    entries = spark.createDataFrame([(1, 100, "grant", None), (1, -30, "job_charge", 7), (2, 5, "grant", None)],
        "user_id int, delta int, reason string, job_id int")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id int")
    assert {r.user_id: r.balance for r in ledger.balances(entries, users).collect()} == {1: 70, 2: 5, 3: 0}
    ask = spark.createDataFrame([(7, 50), (8, 5)], "job_id int, amount int")
    assert {r.job_id: r.refund for r in ledger.refunds(ask, entries).collect()} == {7: 30, 8: 0}


def test_charges_depend_on_what_was_accepted_before(spark):
    requests = spark.createDataFrame([(1, 1, 60, "a"), (1, 2, 60, "b"), (1, 3, 40, "c"), (1, 4, 60, "a"), (1, 5, 1, None), (1, 6, 0, None),
        (2, 1, 1, None)], "user_id int, seq long, amount int, idem string")
    opening = spark.createDataFrame([(1, 100)], "user_id int, balance int")
    got = {(r.user_id, r.seq): (r.accepted, r.balance) for r in ledger.charges(requests, opening).collect()}
    assert got == {(1, 1): (True, 40), (1, 2): (False, 40), (1, 3): (True, 0), (1, 4): (True, 0), (1, 5): (False, 0), (1, 6): (False, 0),
        (2, 1): (False, 0)}


def test_costs(spark):
    prices = spark.createDataFrame([("m", "2026-01-01", "0.75", "3.0", "0.075", "0.5"), ("m", "2027-01-01", "1.5", "6.0", None, "0.5")],
                                   "model string, effective_from string, input_per_mtok string, output_per_mtok string, cached_input_per_mtok string, batch_multiplier string")
    prices = prices.selectExpr("model", "date(effective_from) AS effective_from", *(f"cast({c} AS decimal(10,4)) AS {c}" for c in prices.columns[2:]))
    rows = [("m", "2026-06-01", 2_000_000, 0, 1_000_000, 0, False), ("m", "2027-01-01", 2_000_000, 0, 1_000_000, 0, False),
        ("m", "2026-06-01", 1_000_000, 1_000_000, 0, 0, False), ("m", "2026-06-01", 2_000_000, 0, 500_000, 500_000, True)]
    calls = spark.createDataFrame(rows, "model string, d string, tokens_in long, tokens_cached long, tokens_out long, tokens_think long, batch boolean").withColumn("day", F.to_date("d"))
    assert sorted(float(r[0]) for r in ledger.priced(calls, prices).select(ledger.cost_usd()).collect()) == [0.075, 2.25, 4.5, 9.0]
    with pytest.raises(Exception, match="no_price_for_model"):
        ledger.priced(calls.withColumn("day", F.to_date(F.lit("2020-01-01"))), prices).collect()


def test_claims(spark):
    t0 = dt.datetime(2026, 1, 1)
    tasks = spark.createDataFrame([(i, i % 3, "pending" if i > 1 else "running", t0 + dt.timedelta(minutes=i), t0) for i in range(12)],
        "task_id int, job_id int, status string, created_at timestamp, run_after timestamp")
    jobs = spark.createDataFrame([(0, "running", False), (1, "running", False), (2, "running", True)],
        "job_id int, status string, cancel_requested boolean")
    now = F.lit(t0 + dt.timedelta(days=1))
    assert sorted(r.task_id for r in queue.claimed(tasks, jobs, now, 10, 2).collect()) == [3, 4]
    assert sorted(r.task_id for r in queue.claimed(tasks, jobs, now, 3, 9).collect()) == [3, 4, 6]


def test_progress_and_stages(spark):
    rows = spark.createDataFrame([(1, "extract", 1, 1), (1, "map", 3, 6), (1, "write", 0, 0)], "job_id int, stage string, done int, total int")
    assert queue.progress(rows).first().pct == 20.0
    assert {r.stage for r in queue.ready_to_advance(rows).collect()} == {"extract", "write"}


def test_day_boundaries_across_summer_time(spark):
    at = int(dt.datetime(2026, 3, 8, 8, 30, tzinfo=dt.timezone.utc).timestamp())  # 00:30 in Los Angeles, a day of 23 hours
    row = spark.createDataFrame([(1790000000,), (at,)], "now long").select(clock.next_day_boundary(F.col("now"), "America/Los_Angeles").alias("n"),
        "now").collect()
    assert {r.now: r.n for r in row} == {1790000000: 1790060400.0, at: at + 22.5 * 3600}


def segments_by_loop(sizes, target, most, least):
    out = []
    for i, t in enumerate(sizes, 1):
        big = out and out[-1][0] == out[-1][1] and out[-1][2] > most
        if not out or t > most or big or not (out[-1][2] + t <= target or out[-1][2] < least):
            out.append([i, i, t])
        else:
            out[-1][1:] = [i, out[-1][2] + t]
    if len(out) > 1 and out[-1][2] < least:
        last = out.pop()
        out[-1][1:] = [last[1], out[-1][2] + last[2]]
    return [tuple(x) for x in out]


def test_segments(spark):
    import random

    draw = random.Random(5)
    docs = {k: [draw.choice([3, 10, 25, 40, 130]) for _ in range(draw.randint(1, 30))] for k in range(40)}
    rows = [(k, i, "x" * (4 * t)) for k, ts in docs.items() for i, t in enumerate(ts, 1)]
    got = {}
    for r in paragraphs.segments(spark.createDataFrame(rows, "doc_id int, idx int, text string"), target=80, most=120, least=25).orderBy("doc_id",
            "segment").collect():
        got.setdefault(r.doc_id, []).append((r.first_idx, r.last_idx, r.tokens))
    assert got == {k: segments_by_loop(ts, 80, 120, 25) for k, ts in docs.items()}


def test_merged_cues(spark):
    rows = spark.createDataFrame([("v", 0.0, "Hello"), ("v", 1.0, "there."), ("v", 1.5, "Next"), ("v", 9.0, "late")],
        "k string, at double, text string")
    assert [r.text for r in paragraphs.merged_cues(rows, "k").orderBy("start").collect()] == ["Hello there.", "Next", "late"]


ENTRIES = [("cloud", "đám mây", True, False, ["mây"]), ("API", "giao diện", False, True, []), ("C++", "C++", False, False, [])]


def entries(spark):
    return spark.createDataFrame(ENTRIES, "source_term string, target_term string, keep_original boolean, case_sensitive boolean, forbidden_variants array<string>")


def test_terms_and_lint(spark):
    texts = spark.createDataFrame([(1, "Clouds and the api."), (2, "the API of C++"), (3, "cloudy")], "k int, text string")
    assert {tuple(r) for r in glossary.terms_in(texts, entries(spark), "k").collect()} == {(1, "cloud"), (2, "API"), (2, "C++")}
    report = spark.createDataFrame([(1, "Dùng mây nhé"), (2, "đám mây là tốt"), (3, "đám mây (cloud) tốt"), (4, "cloud tốt")], "k int, text string")
    first = spark.createDataFrame([(2, "cloud"), (3, "cloud")], "k int, source_term string")
    got = {(r.k, r.kind) for r in glossary.lint(report, entries(spark), "k", first).collect()}
    assert got == {(1, "forbidden_variant"), (2, "forbidden_variant"), (2, "missing_original_on_first_use"), (3, "forbidden_variant"),
        (4, "untranslated_source_term")}


def test_merged_candidates(spark):
    rows = spark.createDataFrame([("d1", "Cloud", "noun", "mây", 2, 0.9, True, ["a"]),
        ("d2", "cloud ", "verb", "đám mây", 3, 0.8, False, ["b", "mây"]), ("d3", "CLOUD", "noun", "mây", 1, 0.7, True, [])],
                                 "doc string, source_term string, term_type string, target_term string, occurrences int, confidence double, keep_original boolean, alternatives array<string>")
    r = glossary.review_order(glossary.merged_candidates(rows)).first()
    assert (r.source_term, r.term_type, r.docs_count, r.occurrences, r.avg_confidence, r.conflict, r.alternatives) == ("Cloud", "noun", 3, 6, 0.8,
        True, ["a", "b"])
    assert [(v.target_term, v.docs) for v in r.variants] == [("mây", 2), ("đám mây", 1)] and (r.keep_votes, r.translate_votes) == (2, 1)


def test_attached_evidence(spark):
    e = spark.createDataFrame([("t", ["C2", "zz", "C1"]), ("u", [])], "entry string, ctx_ids array<string>")
    c = spark.createDataFrame([("C1", "d1", "one"), ("C2", "d2", "two")], "ctx_id string, doc string, snippet string")
    assert {r.entry: [x.snippet for x in r.evidence] for r in glossary.with_evidence(e, c).collect()} == {"t": ["two", "one"], "u": []}


def test_estimates(spark):
    row = spark.range(1).select(
        estimates.report_budget_words(F.lit(90_000), F.lit("deep_synthesis")).alias("b"),
        estimates.estimate(F.lit(90_000), F.lit("deep_synthesis"), F.lit("en"), F.lit(0.75), F.lit(3.0)).alias("e"),
        *(estimates.estimate_calls(F.lit(90_000), F.lit(k), F.lit("en")).alias(k) for k in estimates.LEVELS),
        estimates.report_budget_words(F.lit(200), F.lit("executive_brief")).alias("small"),
        estimates.docs_per_day(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(1), F.lit(1)).alias("inf")).first()
    assert (row.b, row.small, row.e.credits, row.inf) == (9000, 160, 300, math.inf)
    assert [row[k] for k in estimates.LEVELS] == [37, 84, 78, 34]


@pytest.mark.parametrize(("status", "body", "finish", "want"), [
    (200, None, "length", "truncated"), (200, None, "stop", "ok"), (200, None, None, "ok"),
    (429, '{"error":{"message":"Too many tokens per minute"}}', None, "rate_limited_minute"),
    (429, '{"error":{"code":"insufficient_quota"}}', None, "rate_limited_day"), (429, None, None, "rate_limited_unknown"),
    (403, None, None, "auth_error"), (413, None, None, "context_exceeded"),
    (400, '{"error":{"message":"maximum context length"}}', None, "context_exceeded"), (422, None, None, "bad_request"), (504, None, None, "timeout"),
    (503, None, None, "server_error"), (418, None, None, "bad_request"),
    (429, '{"error":{"details":[{"violations":[{"quotaId":"GenerateRequestsPerDayPerProject"}]}]}}', None, "rate_limited_day"),
])
def test_http(spark, status, body, finish, want):
    row = spark.createDataFrame([(status, body, finish)], "s int, b string, f string")
    assert row.select(http.classify_http(F.lit("gemini_native"), F.col("s"), F.col("b"), F.col("f"))).first()[0] == want


def test_headroom_and_capacity(spark):
    ratios = spark.createDataFrame([("a", 0.4), ("a", None), ("a", 0.9), ("b", None), ("c", -0.2)], "deployment string, ratio double")
    assert {r.deployment: r.headroom for r in pool.headroom(ratios).collect()} == {"a": 0.4, "b": 1.0, "c": 0.0}


def test_checks(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (2, -1, "z"), (3, None, None)], "id int, n int, s string")
    rules = {"positive": F.col("n") > 0, "known": F.col("s").isin("a", "b")}
    assert {tuple(r) for r in checks.violations(rows, "id", rules).collect()} == {(2, "positive"), (2, "known")}
    with pytest.raises(Exception, match="check_violation"):
        checks.enforced(rows, rules).collect()
    old = spark.createDataFrame([(1, "x", "approved"), (2, "x", "approved"), (3, "x", "approved"), (4, "x", "draft"), (5, "x", "approved")],
        "id int, content string, status string")
    new = spark.createDataFrame([(1, "y", "approved"), (2, "x", "draft"), (5, "x", "deprecated")], "id int, content string, status string")
    assert {tuple(r) for r in checks.frozen(old, new, "id").collect()} == {(1, "content_changed"), (2, "bad_status"), (3, "deleted")}


def test_refund_requests_do_not_hang_on_the_order_of_events(spark, tmp_path):
    # Eighty tenths are 8; added as doubles in this order they are 7.99...
    rows = [(i, 1, "purchase", 0.08) for i in range(100)] + [(100 + i, 2, "view", 0.1) for i in range(80)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = {r.job_id: (r.amount, r.refund) for r in accounts.refund_credits(spark, str(tmp_path)).collect()}
    assert found == {1: (1, 0), 2: (1, 0)}


def test_rules_of_a_style_go_by_their_numbers(spark):
    rules = spark.createDataFrame([("c", f"R{n:05d}", "must", "x") for n in (100_000, 99_999, 7, 1_000_000)] + [("c", "R00008", "may", "x"), ("c", "A9", "must", "x"), ("c", "A", "must", "x")],
        "core string, rule string, severity string, text string")
    lines = reports.style_block(rules, 1000).first().text.split("\n")
    assert [x[3:-3] for x in lines] == ["A", "A9", "R00007", "R99999", "R100000", "R1000000", "R00008"]


def test_reports(spark):
    rules = spark.createDataFrame([("c", "r2", "may", "m" * 50), ("c", "r1", "must", "keep <x>"), ("c", "r3", "should", "s" * 50)],
        "core string, rule string, severity string, text string")
    full = reports.style_block(rules, 1000).first().text
    assert [x[:6] for x in full.split("\n")] == ["- [r1]", "- [r3]", "- [r2]"] and "‹x›" in full
    assert reports.style_block(rules, 90).first().text.count("\n") == 1 and reports.style_block(rules, 5).first().text == "- [r1] keep ‹x›"
    child = spark.createDataFrame([("a", "unspecified"), ("b", "1"), ("d", "")], "name string, value string")
    parent = spark.createDataFrame([("a", "x"), ("b", "y")], "name string, value string")
    assert {r.name: r.value for r in reports.overlaid(child, parent).collect() if r.value} == {"a": "x", "b": "1"}
    table = reports.markdown_table(spark.createDataFrame([(2, "b"), (1, None)], "n int, s string"), "n").first().text
    assert table == "| n | s |\n| --- | --- |\n| 1 |  |\n| 2 | b |"


def test_release_gate(spark):
    cols = "suite string, coverage double, faithfulness double, cost double, p95 double"
    old, new = spark.createDataFrame([("s", 0.98, 0.99, 1.0, 10.0)], cols), spark.createDataFrame([("s", 0.94, 0.98, 1.3, 12.0)], cols)
    assert {r.problem for r in reports.release_gate(old, new).collect()} == {"coverage", "cost"}


def test_citation_numbers_leave_no_task_with_all_units(spark):
    units = [None if u == 77 else u for u in range(5000)]
    rows = [(None if i == 5 else (i * 7919) % 1000, u) for i, u in enumerate(units)] + [(2000, u) for u in units]
    cites = spark.createDataFrame(rows, "pos long, unit long")
    first = {}
    for pos, u in rows:
        if pos is not None:
            first[u] = min(pos, first.get(u, pos))
    order = sorted(first, key=lambda u: (first[u], u is not None, u or 0))
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        got = reports.citation_numbers(cites).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(conf)
    assert {r.unit: r.number for r in got} == {u: i + 1 for i, u in enumerate(order)} and len(got) == 5000
    by_task = [sum(r.task == t for r in got) for t in {r.task for r in got}]
    assert max(by_task) < 0.6 * len(got)
    assert reports.citation_numbers(cites.limit(0)).count() == 0


def test_dense_numbers_by_many_ranges(spark, monkeypatch):
    from loomwork.operators import scale

    monkeypatch.setattr(scale, "RANGE", 2)
    rows = spark.range(1000).selectExpr("(id * 7919) % 1009 AS k", "id AS v")
    got = [(r.k, r.n) for r in scale.dense_numbers(rows, ["k", "v"], "n").collect()]
    assert sorted(got) == [(k, i) for i, k in enumerate(sorted(k for k, _ in got), 1)]
