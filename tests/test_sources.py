import json

from loomwork.operators import pool
from loomwork.sources import text as S
from pyspark.sql import functions as F


def test_texts_and_admission(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿héllo\n\nworld".encode())
    (tmp_path / "b.txt").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "c.txt").write_bytes(b"")
    assert {r.text for r in S.texts(spark, str(tmp_path / "a.txt")).collect()} == {"héllo\n\nworld"}
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.problem) for r in S.admitted(spark, str(tmp_path), most=12).collect()}
    assert got == {"a.txt": ("text", "too_big"), "b.txt": ("pdf", None)}


def test_subtitles(spark):
    srt = "1\n00:00:01,500 --> 00:00:02,000\nHello <i>there</i>\nfriend\n\n2\n01:00:00,000 --> 01:00:01,000\nBye\n"
    vtt = "WEBVTT\n\n00:01.000 --> 00:02.500 align:start\nHi\n"
    rows = spark.createDataFrame([(srt,), (vtt,)], "t string").select(S.cues(F.col("t")).alias("c")).collect()
    assert [(c.start, c.end, c.text) for c in rows[0].c] == [(1.5, 2.0, "Hello there friend"), (3600.0, 3601.0, "Bye")]
    assert [(c.start, c.end, c.text) for c in rows[1].c] == [(1.0, 2.5, "Hi")]


def test_glossary_round_trip(spark, tmp_path):
    (tmp_path / "g.csv").write_text("﻿source_term,target_term,keep_original,case_sensitive,forbidden_variants,term_type,note\ncloud,đám mây,true,,mây | cloudy,noun,\n,x,,,,,\n", encoding="utf-8")
    rows = S.read_glossary(spark, str(tmp_path / "g.csv"))
    assert [(r.source_term, r.keep_original, r.case_sensitive, r.forbidden_variants) for r in rows.collect()] == [("cloud", True, False,
        ["mây", "cloudy"])]
    S.write_glossary(rows, str(tmp_path / "out"))
    assert S.read_glossary(spark, str(tmp_path / "out")).collect() == rows.collect()


def test_prompts(spark, tmp_path):
    (tmp_path / "p.md").write_text("---\nid: p\nvariables: [a]\n---\n## SYSTEM\nBe {{a}}.\n\n## USER\nGo.\n")
    r = S.prompts(spark, str(tmp_path / "p.md")).first()
    assert (r.front, r.system, r.user) == ("id: p\nvariables: [a]", "Be {{a}}.", "Go.")


def test_pool_configuration(spark, tmp_path):
    cfg = {"policy": {}, "models": [{"id": "m", "provider": "p", "ctx_in": 8000, "max_out": 2000, "structured": "json_object",
        "quality": {"write": 0.5}}],
           "groups": [{"id": "g", "provider": "p", "tier": "free", "data_policy": "no_training",
           "credentials": [{"id": "c1"}, {"id": "c2", "status": "quarantined"}]}],
           "deployments": [{"id": "d1", "group": "g", "model": "m", "tags": ["fast"]}, {"id": "d2", "group": "g", "model": "m", "enabled": False}]}
    (tmp_path / "pool.json").write_text(json.dumps(cfg))
    deps = S.pool_deployments(spark, str(tmp_path / "pool.json"))
    assert {(r.deployment, r.enabled, r.active_credentials) for r in deps.collect()} == {("d1", True, 1), ("d2", False, 1)}
    requests = spark.createDataFrame(
        [(1, [], "none", False, False, {"write": 0.4}, "A", "private", False, False, 1000, 500, 0, [], ["fast"], []),
        (2, [], "none", False, False, {"write": 0.6}, "A", "standard", False, False, 1000, 500, 0, [], [], [])],
        "request int, exclude array<string>, structured string, needs_vision boolean, needs_pdf boolean, min_quality map<string,double>, gate string, privacy string, region_restricted boolean, allow_metered boolean, "
        "est_in int, est_out int, min_ctx_in int, avoid_groups array<string>, select_tags array<string>, select_tiers array<string>")
    assert [(r.request, r.deployment) for r in pool.candidates(requests, deps).collect()] == [(1, "d1")]
