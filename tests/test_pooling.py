"""Schemas, declarations, shared tables, job states, orders of candidates and archives, by hand."""

import io
import json
import zipfile
from collections import Counter

import pytest
from loomwork.operators import declarations, policies, pool, queue, reports, schemas, styles
from loomwork.plans import pooling
from loomwork.sources import shared
from loomwork.sources import text as sources
from pyspark.sql import functions as F


def checked(spark, schema, *values):
    rows = spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    out = [[] for _ in values]
    for r in schemas.schema_problems(rows, "i", "t", schema).collect():
        out[r.i].append((r.path, r.problem))
    return [sorted(x) for x in out]


def test_the_good_reply_and_every_mutation(spark):
    replies = [pooling.REPLY, *(pooling.REPLY.replace(old, new) for old, new, *_ in pooling.MUTATIONS[:-1]), pooling.REPLY[:-1], None]
    want = [[], *([(path, problem)] for *_, path, problem in pooling.MUTATIONS), [("$", "unreadable")]]
    assert checked(spark, pooling.SCHEMA, *replies) == want


def test_nesting_and_types(spark):
    tree = {"$defs": {"n": {"type": "object", "properties": {"v": {"type": "integer"}, "kids": {"type": "array", "items": {"type": "object", "properties": {"v": {"type": "integer"}}}}}}}, "$ref": "#/$defs/n"}
    assert checked(spark, tree, {"v": 1, "kids": [{"v": 2}, {"v": "x"}, 3]}, {"v": 1.5}, {"v": None}, [], '"text"') == [
        [("$.kids[1].v", "type"), ("$.kids[2]", "type")], [("$.v", "type")], [("$.v", "type")], [("$", "type")], [("$", "type")]]
    odd = {"type": "object", "properties": {"it's a.b": {"enum": ["é", 1, None]}}, "required": ["it's a.b"], "additionalProperties": False}
    assert checked(spark, odd, {"it's a.b": "é"}, {"it's a.b": None}, {"it's a.b": 2}, {}) == [[], [], [("$.it's a.b", "enum")], [("$.it's a.b", "required")]]


def test_unknown_keywords_and_endless_references_are_refused():
    with pytest.raises(ValueError, match="oneOf"):
        schemas.problems(F.lit(1), {"oneOf": []})
    with pytest.raises(ValueError, match="deep"):
        schemas.resolved({"$ref": "#/$defs/a"}, {"a": {"$ref": "#/$defs/a"}})


KEYS = "declaration int, pos int, fingerprint string, label string, status string"


def test_first_claims(spark):
    rows = [(1, 1, "a", None, "ok"), (1, 2, "a", None, "ok"), (2, 1, "a", None, "ok"), (2, 2, "b", None, "ok"), (2, 3, "c", None, "ok"), (2, 4, "c", None, "too_short"), (3, 1, None, None, "invalid")]
    known = spark.createDataFrame([("b",), (None,)], "fingerprint string")
    got = {(r.declaration, r.pos): r.status for r in declarations.judged(spark.createDataFrame(rows, KEYS), known).collect()}
    assert got == {(1, 1): "ok", (1, 2): "duplicate_in_request", (2, 1): "duplicate_across", (2, 2): "duplicate_existing", (2, 3): "ok", (2, 4): "too_short", (3, 1): "invalid"}


def test_groups_flags_and_gates(spark):
    keys = spark.createDataFrame([(1, 1, "a", None, "ok"), (1, 2, "b", "team", "ok"), (2, 1, "c", None, "ok"), (3, 1, "d", None, "ok"), (3, 2, "e", None, "ok")], KEYS)
    decl = spark.createDataFrame([(1, "p", "free", "per_key", [], ["multi_account_risk"]), (2, "p", "free", "per_key", [], []), (3, "q", "trial", "single_group", ["x"], ["trial_only"])],
                                 "declaration int, provider string, tier string, mode string, tos_flags array<string>, risk_ack array<string>")
    old = spark.createDataFrame([("q-paid-7", "q", "paid", [], [])], "group_id string, provider string, tier string, tos_flags array<string>, risk_ack array<string>")
    plan = declarations.planned(keys, decl, old)
    assert sorted((r.declaration, r.group_id) for r in plan.collect()) == [(1, "p-free-1"), (1, "p-free-team"), (2, "p-free-2"), (3, "q-trial"), (3, "q-trial")]
    got = {(r.declaration, r.group_id): (r.tos_flags, r.allowed_gates, r.problem) for r in declarations.derived(plan, decl, old).collect()}
    assert got[1, "p-free-1"] == (["multi_account_risk"], ["dev", "A"], None)
    assert got[2, "p-free-2"] == (["multi_account_risk"], ["dev", "A"], "risk_not_accepted multi_account_risk")
    assert got[3, "q-trial"] == (["no_personal_data", "trial_only", "x"], ["dev"], None)


def test_a_failure_between_two_tables_leaves_the_old_state(spark, tmp_path):
    root = f"file://{tmp_path}/pool"
    rows = lambda *ids: spark.createDataFrame([(i, f"n{i}") for i in ids], "id int, name string")
    assert shared.applied(spark, root, "one", {"a": (rows(1, 2, 2), "id"), "b": (rows(7), "id")}) == {"a": 2, "b": 1}
    broken = rows(8).withColumn("name", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        shared.applied(spark, root, "two", {"a": (rows(2, 3), "id"), "b": (broken, "id")})
    held = lambda t: sorted(r.id for r in shared.current(spark, root, t, rows(1).schema).collect())
    assert held("a") == [1, 2] and held("b") == [7]  # folders of the failed change are there, but no manifest names them
    assert shared.applied(spark, root, "two", {"a": (rows(2, 3), "id"), "b": (rows(7, 8), "id")}) == {"a": 1, "b": 1}
    assert shared.applied(spark, root, "two", {"a": (rows(2, 3), "id"), "b": (rows(7, 8), "id")}) == {"a": 1, "b": 1}
    assert held("a") == [1, 2, 3] and held("b") == [7, 8]


def test_two_changes_cannot_take_one_number(spark, tmp_path):
    root = f"file://{tmp_path}/pool"
    state = {"number": 1, "tables": {}, "applied": {}}
    shared._commit(spark, root, state)
    with pytest.raises(Exception, match="[Ee]xist"):
        shared._commit(spark, root, state | {"applied": {"late": {}}})
    assert shared.manifest(spark, root) == state


def test_a_call_log_takes_no_batch_twice_and_no_content(spark, tmp_path):
    path = f"file://{tmp_path}/calls"
    batch = spark.createDataFrame([("2026-01-01", 1), ("2026-01-02", 2)], "day string, tokens int")
    for k in (0, 1, 1):
        shared.logged(batch, k, path)
    assert spark.read.parquet(path).count() == 4
    with pytest.raises(ValueError, match="Prompt|prompt"):
        shared.logged(batch.withColumn("Prompt", F.lit("x")), 2, path)


def test_a_stream_writes_the_log(spark, tmp_path):
    spark.createDataFrame([("2026-01-01", 1), ("2026-01-02", 2)], "day string, tokens int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("day string, tokens int").parquet(f"{tmp_path}/in")
    out = stream.writeStream.foreachBatch(lambda b, k: shared.logged(b, k, f"{tmp_path}/log")).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2


def test_job_moves(spark):
    steps = ["queued", "running", "awaiting_glossary", "running", "succeeded", "expired", "running"]
    log = spark.createDataFrame([("j", i, i * 40_000, s) for i, s in enumerate(steps)] + [("k", 9, 5, "running")], "job_id string, seq int, at long, status string")
    for width in (10, 100_000, 10**9):
        got = {(r.job_id, r.seq): (r.was, r.legal) for r in queue.job_moves(log, width).collect()}
        assert [got["j", i] for i in range(7)] == list(zip([None, *steps], [True] * 6 + [False])) and got["k", 9] == (None, False)


def test_next_stages(spark):
    rows = [("a", 1, "x", "succeeded"), ("a", 2, "y", "skipped"), ("a", 3, "z", "pending"), ("b", 1, "x", "running"), ("b", 2, "y", "pending"), ("c", 1, "x", "succeeded"), ("d", 1, "x", "failed"), ("d", 2, "y", "pending")]
    stages = spark.createDataFrame(rows, "job_id string, n int, stage string, status string")
    assert [tuple(r) for r in queue.next_stages(stages).collect()] == [("a", "z")]


def test_orders_follow_weights_and_agree(spark):
    found = spark.range(4000).withColumnRenamed("id", "request").crossJoin(spark.createDataFrame([("a", 6.0), ("b", 3.0), ("c", 1.0)], "deployment string, score double"))
    first = lambda df: Counter(r.deployment for r in df.where("place = 1").collect())
    one = first(pool.shuffled(found))
    assert abs(one["a"] / 4000 - 0.6) < 0.03 and abs(one["c"] / 4000 - 0.1) < 0.02 and one == first(pool.shuffled(found.repartition(3)))
    two = first(pool.two_choices(found))
    assert abs(two["b"] / 4000 - 1 / 3) < 0.03 and "c" not in two
    assert all(sorted(r.p) == [1, 2, 3] for r in pool.two_choices(found).groupBy("request").agg(F.collect_list("place").alias("p")).collect())


def test_stage_stats(spark):
    units = spark.createDataFrame([(1, "core", "used", None), (1, "core", "omitted", "off"), (1, "minor", "omitted", "off")], "doc_id int, importance string, state string, reason string")
    got = {(r.by, r.importance, r.state, r.reason): r.n for r in policies.stage_stats(units).collect()}
    assert got["importance", "core", None, None] == 2 and got["state", None, "omitted", None] == 2 and got["importance,state", "core", "used", None] == 1
    assert got["reason", None, None, "off"] == 2 and len(got) == 2 + 2 + 3 + 1


def zipped(files, mode=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", mode) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives_are_judged_by_their_directory(spark, tmp_path):
    good = zipped({"a.xml": b"<a/>" * 20, "b/c.xml": b"hello"})
    locked = bytearray(good)
    at = locked.index(b"PK\x01\x02")
    locked[at + 8] |= 1
    files = {"good": good, "bomb": zipped({"x": b"\0" * 3_000_000}), "locked": bytes(locked), "cut": good[: len(good) // 2], "empty": zipped({}),
             "pdf": b"%PDF-1.7\n1 0 obj\ntrailer\n<< /Root 1 0 R >>\n%%EOF", "sealed": b"%PDF-1.7\ntrailer\n<< /Encrypt 5 0 R >>\n%%EOF", "text": b"PK is no archive"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.entries, r.unpacked, r.problem) for r in sources.inspected(spark, str(tmp_path)).collect()}
    assert got["good"] == ("zip", 2, 85, None) and got["bomb"] == ("zip", 1, 3_000_000, "bomb") and got["locked"][3] == "encrypted"
    assert got["cut"][3] == "odd_archive" and got["empty"][0] == "zip" and got["empty"][3] is None
    assert got["pdf"] == ("pdf", None, None, None) and got["sealed"][3] == "encrypted" and got["text"] == ("text", None, None, None)


def test_styles_shrink_until_they_fit(spark):
    text = lambda cap: styles.compiled(
        spark.createDataFrame([(1, cap, "plain", "Be <brief>", "same", "unspecified", "unspecified", "noted", "unspecified", "unspecified", "unspecified", None)],
                              "core int, cap int, register string, voice_notes string, first_use string, unknown_terms string, proper_names string, policy_notes string, quotes string, lists string, numbers string, formatting_notes string"),
        spark.createDataFrame([(1, "R2", "must", "b", None), (1, "R1", "must", " a ", []), (1, "R3", "should", "c", ["write"]), (1, "R4", "may", "d", None), (1, "R5", "must", "x", ["map"])],
                              "core int, id string, severity string, text string, applies_to array<string>"),
        spark.createDataFrame([(1, i, f"E{i}", "s", "t", "n" if i == 1 else None, None) for i in range(3)], "core int, pos int, id string, source string, target string, note string, applies_to array<string>"),
        "write").first()["text"]
    head = "Register: plain. Be ‹brief›\nTerminology policy: first_use=same. noted\nRules (MUST):\n- [R1] a\n- [R2] b"
    pairs = "\nExamples (source => target):\n[E0] s => t\n[E1] s => t (n)"
    whole = head + "\nRules (SHOULD):\n- [R3] c\nRules (MAY):\n- [R4] d" + pairs + "\n[E2] s => t"
    texts = [whole, whole.replace("\nRules (MAY):\n- [R4] d", ""), head + pairs + "\n[E2] s => t", head + pairs, head]
    for t in texts:
        assert text(len(t)) == t
    assert text(5) == "Register: plain.\nTerminology policy: first_use=same.\nRules (MUST):\n- [R1] a\n- [R2] b"


def test_sections_of_plans(spark):
    sections = spark.createDataFrame([("a", 1, "summary", 50), ("a", 2, "body", 50), ("b", 2, "summary", 10), ("b", 2, "body", 10), ("b", 1, "body", 10)], "plan string, pos int, kind string, budget int")
    plans = spark.createDataFrame([("a", 110), ("b", 100), ("c", 0)], "plan string, words int")
    got = {(r.plan, r.problem) for r in reports.section_problems(sections, plans, 2, 2).collect()}
    assert got == {("b", "many_sections"), ("b", "no_summary_first"), ("b", "repeated_place"), ("b", "budget"), ("c", "few_sections"), ("c", "no_summary_first")}
