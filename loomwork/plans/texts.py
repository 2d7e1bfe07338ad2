"""Queries on paragraphs, evidence, glossaries, numbers, estimates and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import clock, estimates, http, numbers, secrets, text
from loomwork.functions import json as J
from loomwork.operators import checks, evidence, glossary, paragraphs, pool, reports
from loomwork.plans import tables as T
from loomwork.plans.tables import JOBS, PARAS, WORDS

TERMS = [("the", "die", True, False, ["ye"]), ("heen", "haus", False, False, ["Inhe", "onhe"]), ("la", "das", True, True, ["que"]),
    ("un", "ein", True, False, ["DE"]),
         ("der", "der", False, False, []), ("en la", "in der", False, False, ["y"])]


def terms(spark):
    return spark.createDataFrame(TERMS, "source_term string, target_term string, keep_original boolean, case_sensitive boolean, forbidden_variants array<string>")


def paragraph_scan(spark, d):
    return T.paras(spark, d).select("doc_id", "idx", "pid", F.length("text").alias("n_chars"))


def norm_for_match(spark, d):
    docs = T.table(spark, d, "documents").withColumn("text", F.regexp_replace("text", r"([a-z]),", "$1-\n"))
    n = text.norm_for_match(F.col("text"))
    return docs.select("doc_id", F.md5(n).alias("norm_md5"), F.md5(text.norm_loose(F.col("text"))).alias("loose_md5"))


def strip_diacritics(spark, d):
    return T.table(spark, d, "documents").select("doc_id", F.md5(text.strip_diacritics(F.col("text"))).alias("bare_md5"))


def diacritic_share(spark, d):
    return T.table(spark, d, "documents").select("doc_id", F.round(text.marked_share(F.col("text")), 9).alias("share"))


def canon_numbers(spark, d):
    i = T.table(spark, d, "lineitem")
    shown = F.when(F.col("l_linenumber") % 2 == 0, F.format_number("l_extendedprice", 2)).otherwise(F.translate(F.format_number("l_extendedprice", 2),
        ",.", ".,"))
    return i.select("l_orderkey", "l_linenumber", numbers.canon_number(shown).alias("number"))


def quote_verification(spark, d):
    p = T.paras(spark, d)
    part = F.substring("text", 3, 40)
    quote = (F.when(F.col("idx") % 4 == 0, F.upper(part)).when(F.col("idx") % 4 == 1,
        F.replace(part, F.lit(" "), F.lit(", "))).when(F.col("idx") % 4 == 2, F.concat(part, F.lit(" zzz"))).otherwise(part))
    e = p.select("doc_id", F.when(F.col("idx") % 9 == 0, F.lit("P999999")).otherwise(F.col("pid")).alias("pid"), quote.alias("quote"))
    return evidence.verified(e, p, ["doc_id", "pid"]).groupBy("doc_id", "status").agg(F.count("*").alias("n"))


def bad_quotes(spark, d):
    p = T.paras(spark, d)
    e = p.select("doc_id", "pid", F.concat(F.substring("text", 1, 20), F.when(F.col("idx") % 3 == 0, " zzzz").otherwise("")).alias("quote"))
    return evidence.unit_verified(evidence.verified(e, p, ["doc_id", "pid"]), "doc_id").select("doc_id", "verified",
        F.round("bad_ratio", 9).alias("bad_ratio"))


def glossary_filter(spark, d):
    return glossary.terms_in(T.table(spark, d, "documents"), terms(spark), "doc_id")


def glossary_lint(spark, d):
    first = glossary.first_uses(first_use_input(spark, d), terms(spark)).select(F.col("section").alias("doc_id"), "source_term")
    return glossary.lint(T.table(spark, d, "documents"), terms(spark), "doc_id", first)


def first_use_input(spark, d):
    return glossary.terms_in(T.table(spark, d, "documents"), terms(spark), "doc_id", False).select(F.col("doc_id").alias("section"),
        F.col("doc_id").alias("pos"), "source_term")


def first_uses(spark, d):
    return glossary.first_uses(first_use_input(spark, d), terms(spark))


def candidates(spark, d):
    i, p = T.table(spark, d, "lineitem"), T.table(spark, d, "part")
    return i.join(p, i["l_partkey"] == p["p_partkey"]).select(
        (F.col("l_suppkey") % 50).alias("doc"), F.when(F.col("l_linenumber") % 2 == 0,
        F.upper("p_type")).otherwise(F.initcap("p_type")).alias("source_term"), F.lit("noun").alias("term_type"),
        F.concat(F.lit("t"), F.col("p_size") % 3).alias("target_term"), F.col("l_linenumber").cast("long").alias("occurrences"),
        (F.floor(F.col("l_discount") * 100) / 100).alias("confidence"),
        (F.col("l_returnflag") == "A").alias("keep_original"),
        F.array(F.col("l_linestatus"), F.concat(F.lit("t"), F.col("l_linenumber") % 4)).alias("alternatives"))


def merge_candidates(spark, d):
    m = glossary.merged_candidates(candidates(spark, d))
    return m.select("key", "docs_count", "occurrences", F.round("avg_confidence", 2).alias("confidence"), "keep_votes", "translate_votes", "conflict",
                    F.array_join(F.transform("variants", lambda v: F.concat(v["target_term"], F.lit(":"), v["docs"])), ",").alias("variants"),
                    F.array_join("alternatives", ",").alias("alternatives"))


def glossary_precedence(spark, d):
    shared = T.table(spark, d, "part").select(F.col("p_type").alias("source_term"),
        F.col("p_brand").alias("target_term")).groupBy("source_term").agg(F.min("target_term").alias("target_term"))
    own = T.table(spark, d, "part").where("p_size < 10").select(F.upper("p_type").alias("source_term"),
        F.col("p_brand").alias("target_term")).groupBy("source_term").agg(F.max("target_term").alias("target_term"))
    return glossary.effective((shared, 10), (own, 20)).select(F.lower("source_term").alias("term"), "target_term", "priority")


def segments(spark, d):
    return paragraphs.segments(T.paras(spark, d), target=400, most=1500, least=150)


def segment_context(spark, d):
    p = T.paras(spark, d)
    return paragraphs.context_before(p, paragraphs.segments(p, target=400, most=1500, least=150)).select("doc_id", "segment",
        F.array_join("context", ",").alias("context"))


def cited_neighbours(spark, d):
    p = T.paras(spark, d)
    return paragraphs.with_neighbours(p.where("idx % 5 = 2"), p).select("doc_id", "idx", "pid")


def label_ranges(spark, d):
    p = T.paras(spark, d)
    r = p.where("idx % 6 = 1").select("doc_id", F.col("idx").alias("range_no"), F.col("idx").alias("from_idx"),
        (F.col("idx") + 3 + F.col("idx") % 5).alias("to_idx"),
                                      F.concat(F.lit("label"), F.col("idx") % 4).alias("label"))
    return paragraphs.labelled(p, r).groupBy("doc_id", "label").agg(F.count("*").alias("n"))


def repeated_lines(spark, d):
    return paragraphs.repeated_lines(T.paras(spark, d), share=0.004)


def budget_words(spark, d):
    w = T.words(spark, d).crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in estimates.LEVELS], "level string")))
    return w.select("doc_id", "level", estimates.report_budget_words(F.col("words") * 20, F.col("level")).alias("budget"))


def cost_estimates(spark, d):
    w = T.words(spark, d).crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in estimates.LEVELS], "level string")))
    e = estimates.estimate(F.col("words") * 20, F.col("level"), F.col("lang"), F.lit(0.3), F.lit(2.5))
    return w.select("doc_id", "level", F.inline(F.array(e)), estimates.estimate_calls(F.col("words") * 20, F.col("level"),
        F.col("lang")).alias("calls"))


def day_boundaries(spark, d):
    e = T.table(spark, d, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("now"))
    zone = "America/Los_Angeles"
    return e.select("event_id", clock.day_key(F.col("now"), zone).alias("day"),
        clock.next_day_boundary(F.col("now"), zone).cast("long").alias("next"))


def http_outcomes(spark, d):
    e = T.table(spark, d, "events")
    status = F.element_at(F.array(*map(F.lit, [200, 429, 401, 400, 413, 500, 504, 404, 418, 429])), (F.col("event_id") % 10 + 1).cast("int"))
    body = F.element_at(F.array(*map(F.lit, ['{"error":{"message":"Requests per day exceeded"}}', '{"error":{"message":"context length"}}',
        '{"error":{"code":"rpm"}}', '{}'])), (F.col("event_id") % 4 + 1).cast("int"))
    finish = F.when(F.col("event_id") % 30 == 0, "length").when(F.col("event_id") % 50 == 0, "SAFETY")
    return e.select("event_id", http.classify_http(F.lit("openai_compat"), status, body, finish).alias("outcome"))


def key_statuses(spark, d):
    c = T.table(spark, d, "customer")
    key = (F.when(F.col("c_custkey") % 7 == 0, F.lit("xxxxxxxxxxxxxxxxxx")).when(F.col("c_custkey") % 7 == 1,
        F.lit("short")).when(F.col("c_custkey") % 7 == 2, F.lit("has blank in it here"))
           .otherwise(F.md5((F.col("c_custkey") % 700).cast("string"))))
    keys = c.select(F.col("c_nationkey").alias("request"), F.col("c_custkey").alias("pos"), key.alias("key"))
    existing = c.where("c_custkey < 100").select(F.md5((F.col("c_custkey") + 650).cast("string")).alias("key"))
    return secrets.judged_keys(keys, existing, "[0-9a-f]+").select("pos", "status")


def eligible_pairs(spark, d):
    n = T.table(spark, d, "nation")
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    k = F.col("n_nationkey")
    deps = n.select(
        F.col("n_name").alias("deployment"), F.col("n_regionkey").cast("string").alias("group_id"), (k % 11 != 0).alias("enabled"),
        (k % 4).alias("active_credentials"),
        F.element_at(strings("none", "json_object", "json_schema"), (k % 3 + 1).cast("int")).alias("structured"),
        F.when(k % 6 == 0, strings("trial_only")).otherwise(strings()).alias("tos_flags"),
        F.when(k % 12 == 0, strings("trial_only")).otherwise(strings()).alias("risk_ack"), (k % 2 == 0).alias("vision"), F.lit(True).alias("pdf"),
        F.create_map(F.lit("write"), (k / 25).cast("double")).alias("quality"), strings("dev", "A", "B").alias("allowed_gates"),
        F.when(k % 3 == 0, "no_training").otherwise("unknown").alias("data_policy"),
        F.when(k % 5 == 0, "metered").otherwise("free").alias("price_mode"), F.lit(1.1).alias("tokenizer_factor"),
        (k * 1000 + 4000).cast("long").alias("ctx_in"), F.lit(4000).alias("max_out"),
        strings("fast").alias("tags"), F.lit("free").alias("tier"), F.lit(1.0).alias("weight"))
    c = F.col("c_custkey")
    reqs = T.table(spark, d, "customer").select(
        c.alias("request"), strings().alias("exclude"), F.element_at(strings("none", "json_object"), (c % 2 + 1).cast("int")).alias("structured"),
        (c % 5 == 0).alias("needs_vision"), F.lit(False).alias("needs_pdf"),
        F.create_map(F.lit("write"), (c % 10 / 20).cast("double")).alias("min_quality"),
        F.element_at(strings("A", "B", "C"), (c % 3 + 1).cast("int")).alias("gate"),
        F.when(c % 4 == 0, "private").otherwise("standard").alias("privacy"), F.lit(False).alias("region_restricted"),
        (c % 2 == 1).alias("allow_metered"), (c * 10).alias("est_in"), F.lit(1000).alias("est_out"),
        F.lit(0).alias("min_ctx_in"), strings().alias("avoid_groups"), strings().alias("select_tags"), strings("free", "paid").alias("select_tiers"))
    return pool.candidates(reqs, deps).select("request", "deployment")


def constraint_violations(spark, d):
    o = T.table(spark, d, "orders")
    rules = {"total_range": F.col("o_totalprice") < 300_000, "status_enum": F.col("o_orderstatus").isin("O", "F"),
        "priority_format": F.col("o_orderpriority").rlike("^[1-4]-"),
             "open_implies_key": (F.col("o_orderstatus") != "O") | (F.col("o_orderkey") % 3 > 0)}
    return checks.violations(o, "o_orderkey", rules)


def duplicate_keys(spark, d):
    return checks.duplicates(T.table(spark, d, "part"), F.lower("p_type"), F.col("p_size")).withColumnsRenamed({"key_0": "p_type", "key_1": "p_size"})


def pid_pairing(spark, d):
    p = T.paras(spark, d).select(F.concat_ws("/", "doc_id", "pid").alias("pid"), "idx", "text")
    t = p.where("idx % 13 <> 0").unionByName(p.where("idx % 17 = 0"))
    return checks.pairing(p, t, "pid")


def translations(spark, d):
    p = T.paras(spark, d).select(F.concat_ws("/", "doc_id", "pid").alias("pid"), "idx", "text")
    t = p.select("pid", F.when(F.col("idx") % 5 == 0, "").when(F.col("idx") % 5 == 1,
        F.substring("text", 1, 20)).otherwise(F.col("text")).alias("text"))
    return checks.translation_problems(p, t, "pid")


def enum_drift(spark, d):
    a = T.table(spark, d, "events").select(F.col("event_type").alias("value"))
    b = spark.createDataFrame([("click",), ("refund",)], "value string")
    return checks.drift(a, b, "value")


def block_checks(spark, d):
    p = T.paras(spark, d)
    extra = F.when(F.col("idx") % 6 == 0, " U-00012 ").when(F.col("idx") % 6 == 1, " <b>x</b> ").when(F.col("idx") % 6 == 2,
        " Certainly, ").otherwise("")
    return reports.block_problems(p.select(F.concat_ws("/", "doc_id", "pid").alias("block"), F.concat("text", extra).alias("text")),
        "block").groupBy("problem").agg(F.count("*").alias("n"))


def citations(spark, d):
    i = T.table(spark, d, "lineitem")
    return reports.citation_numbers(i.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_partkey").alias("unit")))


def style_chains(spark, d):
    c = T.table(spark, d, "customer")
    parent = F.when(F.col("c_custkey") % 50 == 7, F.col("c_custkey")).when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 4)).cast("long")
    parent = F.when(parent > 0, parent)
    return reports.inherited(c.select(F.col("c_custkey").alias("core"), parent.alias("parent"))).select("core", "depth", "problem")


def report_patches(spark, d):
    b = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("section"),
        F.col("l_linenumber").alias("pos")).agg(F.min("l_returnflag").alias("text"))
    b = b.select("section", "pos", F.concat_ws(".b", "section", "pos").alias("block"), "text")
    k = F.col("pos")
    return reports.patched(b, b.where(k == 2).select("block", F.lit("new").alias("text")),
        b.where(k == 3).select(F.col("block").alias("after_block"), F.concat("block", F.lit("+")).alias("block"), F.lit("added").alias("text")),
                           b.where(k == 1).select("block"))


def grades(spark, d):
    i = T.table(spark, d, "lineitem")
    rows = i.select(F.col("l_suppkey").alias("report"), (F.col("l_tax") < 0.08).alias("covered"), (F.col("l_discount") < 0.1).alias("faithful"),
        (F.col("l_quantity") < 50).alias("resolved"))
    return reports.grades(rows).select("report", F.round("coverage", 9).alias("coverage"), F.round("faithfulness", 9).alias("faithfulness"),
        "unresolved", "grade")


def plan_checks(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"),
        F.when(F.col("o_orderpriority").startswith("1"), "core").otherwise("minor").alias("importance"))
    plan = T.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("section"),
        (F.col("l_orderkey") + F.when(F.col("l_orderkey") % 97 == 0, 10**8).otherwise(0)).alias("unit"))
    return reports.plan_problems(plan, o)


def extract_json(spark, d):
    e = T.table(spark, d, "events")
    reply = F.concat(F.when(F.col("event_id") % 3 == 0, "<think>{no}</think> Sure: ").when(F.col("event_id") % 3 == 1, "```json\n").otherwise(""),
        "props", F.when(F.col("event_id") % 3 == 1, "\n```").otherwise(" done"))
    return e.select("event_id", F.get_json_object(J.extract_json(reply), "$.k").alias("k"))


def prompt_render(spark, d):
    n = T.table(spark, d, "nation")
    template = F.lit("Hello {{ name }} of {{region}}; {{name}}!")
    variables = F.create_map(F.lit("name"), F.concat("n_name", F.lit(" {{region}}")), F.lit("region"), F.col("n_regionkey").cast("string"))
    return n.select("n_nationkey", reports.rendered(template, variables).alias("text"))


def daily_capacity(spark, d):
    p = T.table(spark, d, "part")
    k = F.col("p_partkey")
    lim = lambda name, every, size: F.when(k % every != 0, (k % 37 + 1) * size).alias(name)
    rows = p.select(k.alias("deployment"), lim("d_rpd", 3, 50), lim("d_rpm", 4, 1), lim("d_tpd", 5, 10_000), lim("d_tpm", 2, 900),
        lim("g_rpd", 2, 400), lim("g_rpm", 6, 3), lim("g_tpd", 7, 90_000), lim("g_tpm", 9, 700),
                    F.lit(0.95).alias("day_margin"), F.lit(0.85).alias("safety_margin"))
    return pool.daily_capacity(rows)


_NORM = ("trim(regexp_replace(replace(translate(regexp_replace(replace(nfc_normalize(X), chr(173), ''), '([\\p{L}\\p{N}_])-[ \\t]*\\n[ \\t]*([\\p{L}\\p{N}_])', '\\1\\2', 'g'), "
         "'‘’‚‛“”„«»–—−‐‑   ', '''''''''\"\"\"\"\"-----   '), '…', '...'), '\\s+', ' ', 'g'), ' ')")


def _norm(x: str) -> str:
    return f"replace(lower({_NORM.replace('X', x)}), 'ß', 'ss')"


def _loose(x: str) -> str:
    return f"regexp_replace(replace(lower(nfc_normalize({x})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


_TERMS = ("terms AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{t}', {str(k).lower()}, {str(c).lower()}, [{', '.join(map(repr, v))}]::VARCHAR[])" for s, t, k, c, v in TERMS)
          + ") t(source_term, target_term, keep_original, case_sensitive, forbidden_variants))")


def _word(term: str, plural: bool = False) -> str:
    return f"'(^|[^\\p{{L}}\\p{{N}}_])' || {term} || '{'(s|es)?' if plural else ''}($|[^\\p{{L}}\\p{{N}}_])'"


def _has(text_: str, pattern: str) -> str:
    return f"regexp_matches({text_}, CASE WHEN case_sensitive THEN '' ELSE '(?i)' END || {pattern})"


_LEVEL = "(VALUES ('full_translation', NULL, NULL, NULL), ('detailed_synthesis', 0.35, 1500, 24000), ('deep_synthesis', 0.12, 800, 9000), ('executive_brief', 0.03, 250, 1500)) v(level, share, low, high)"
_BUDGET = "CASE WHEN share IS NULL THEN words * 20 ELSE CAST(least(high, greatest(low, round_even(CAST(words * 20 * CAST(share AS DOUBLE) AS DOUBLE), 0)), greatest(100, floor(words * 20 * 0.8::DOUBLE))) AS BIGINT) END"

QUERIES = {
    "paragraph_scan": (paragraph_scan, f"WITH {PARAS} SELECT doc_id, CAST(idx AS INT) AS idx, pid, CAST(length(text) AS INT) AS n_chars FROM paras"),
    "norm_for_match": (norm_for_match, f"WITH d AS (SELECT doc_id, regexp_replace(text, '([a-z]),', '\\1-' || chr(10), 'g') AS text FROM documents) SELECT doc_id, md5({_norm('text')}) AS norm_md5, md5({_loose('text')}) AS loose_md5 FROM d"),
    "strip_diacritics": (strip_diacritics, "SELECT doc_id, md5(replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'D')) AS bare_md5 FROM documents"),
    "diacritic_share": (diacritic_share, "SELECT doc_id, CASE WHEN length(l) > 0 THEN round(length(regexp_replace(l, '[A-Za-z]+', '', 'g')) / length(l), 9) ELSE 0 END AS share FROM (SELECT doc_id, regexp_replace(text, '[^\\p{L}]+', '', 'g') AS l FROM documents)"),
    "canon_numbers": (canon_numbers, "SELECT l_orderkey, l_linenumber, regexp_replace(printf('%.2f', l_extendedprice), '[.]?0+$', '') AS number FROM lineitem"),
    "quote_verification": (quote_verification, f"""WITH {PARAS},
e AS (SELECT doc_id, CASE WHEN idx % 9 = 0 THEN 'P999999' ELSE pid END AS pid, CASE idx % 4 WHEN 0 THEN upper(substr(text, 3, 40)) WHEN 1 THEN replace(substr(text, 3, 40), ' ', ', ')
  WHEN 2 THEN substr(text, 3, 40) || ' zzz' ELSE substr(text, 3, 40) END AS quote FROM paras)
SELECT e.doc_id, CASE WHEN p.text IS NULL THEN 'unknown_pid' WHEN {_norm('quote')} = '' THEN 'missing' WHEN contains({_norm('p.text')}, {_norm('quote')}) THEN 'exact'
  WHEN {_loose('quote')} <> '' AND contains({_loose('p.text')}, {_loose('quote')}) THEN 'loose' ELSE 'missing' END AS status, count(*) AS n
FROM e LEFT JOIN paras p ON p.doc_id = e.doc_id AND p.pid = e.pid GROUP BY 1, 2"""),
    "bad_quotes": (bad_quotes, f"""WITH {PARAS}, e AS (SELECT doc_id, text, substr(text, 1, 20) || CASE WHEN idx % 3 = 0 THEN ' zzzz' ELSE '' END AS quote FROM paras),
s AS (SELECT doc_id, {_norm('quote')} <> '' AND contains({_norm('text')}, {_norm('quote')}) OR {_loose('quote')} <> '' AND contains({_loose('text')}, {_loose('quote')}) AS good FROM e)
SELECT doc_id, bool_or(good) AS verified, round(avg(CASE WHEN good THEN 0 ELSE 1 END), 9) AS bad_ratio FROM s GROUP BY 1"""),
    "glossary_filter": (glossary_filter, f"WITH {_TERMS} SELECT doc_id, source_term FROM documents, terms WHERE {_has('text', _word('source_term', True))}"),
    "first_uses": (first_uses, f"WITH {_TERMS} SELECT source_term, min(doc_id) AS section FROM documents, terms WHERE keep_original AND {_has('text', _word('source_term'))} GROUP BY 1"),
    "glossary_lint": (glossary_lint, f"""WITH {_TERMS},
f AS (SELECT source_term, min(doc_id) AS first FROM documents, terms WHERE keep_original AND {_has('text', _word('source_term'))} GROUP BY 1),
r AS (SELECT d.doc_id, d.text, t.*, f.first IS NOT NULL AND f.first = d.doc_id AS is_first,
  regexp_replace(d.text, CASE WHEN case_sensitive THEN '' ELSE '(?i)' END || target_term || '\\s*\\(\\s*' || t.source_term || '\\s*\\)', ' ', 'g') AS bare
  FROM documents d CROSS JOIN terms t LEFT JOIN f ON f.source_term = t.source_term),
v AS (SELECT DISTINCT doc_id, source_term FROM (SELECT *, unnest(forbidden_variants) AS fv FROM r) WHERE {_has('text', _word('fv'))})
SELECT doc_id, source_term, 'forbidden_variant' AS kind FROM v
UNION ALL SELECT doc_id, source_term, 'missing_original_on_first_use' FROM r WHERE keep_original AND is_first AND {_has('text', _word('target_term'))}
  AND NOT {_has('text', "target_term || '\\s*\\(\\s*' || source_term || '\\s*\\)'")}
UNION ALL SELECT doc_id, source_term, 'untranslated_source_term' FROM r WHERE lower(source_term) <> lower(target_term) AND {_has('bare', _word('source_term'))}"""),
    "merge_candidates": (merge_candidates, """
WITH c AS (SELECT l_suppkey % 50 AS doc, lower(p_type) AS key, 't' || (p_size % 3) AS target, l_linenumber AS occ, floor(l_discount * 100) / 100 AS conf, l_returnflag = 'A' AS keep,
  [l_linestatus, 't' || (l_linenumber % 4)] AS alts FROM lineitem JOIN part ON l_partkey = p_partkey),
v AS (SELECT key, string_agg(target || ':' || n, ',' ORDER BY n DESC, target) AS variants, list(target) AS ts, count(*) AS nv FROM (SELECT key, target, count(DISTINCT doc) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT key, list(DISTINCT alt) AS alts FROM (SELECT key, unnest(alts) AS alt FROM c) GROUP BY 1)
SELECT c.key, count(DISTINCT doc) AS docs_count, CAST(sum(occ) AS BIGINT) AS occurrences, round(round_even(avg(conf), 3), 2) AS confidence, count(*) FILTER (keep) AS keep_votes, count(*) FILTER (NOT keep) AS translate_votes,
  any_value(nv) > 1 AS conflict, any_value(v.variants) AS variants, array_to_string(list_sort(list_filter(any_value(a.alts), lambda x: NOT list_contains(any_value(v.ts), x)))[1:5], ',') AS alternatives
FROM c JOIN v USING (key) JOIN a USING (key) GROUP BY c.key"""),
    "glossary_precedence": (glossary_precedence, """
WITH s AS (SELECT p_type AS term, min(p_brand) AS target, 10 AS priority FROM part GROUP BY 1 UNION ALL SELECT upper(p_type), max(p_brand), 20 FROM part WHERE p_size < 10 GROUP BY 1)
SELECT lower(term) AS term, arg_max(target, priority) AS target_term, max(priority) AS priority FROM s GROUP BY 1"""),
    "segments": (segments, None),
    "segment_context": (segment_context, None),
    "cited_neighbours": (cited_neighbours, f"WITH {PARAS} SELECT DISTINCT p.doc_id, CAST(p.idx AS INT) AS idx, p.pid FROM paras p JOIN paras c ON c.doc_id = p.doc_id AND c.idx % 5 = 2 AND p.idx BETWEEN c.idx - 1 AND c.idx + 1"),
    "label_ranges": (label_ranges, f"""WITH {PARAS}, r AS (SELECT doc_id, idx AS n, idx AS a, idx + 3 + idx % 5 AS b, 'label' || (idx % 4) AS label FROM paras WHERE idx % 6 = 1),
l AS (SELECT p.doc_id, p.idx, arg_min(r.label, r.n) AS label FROM paras p LEFT JOIN r ON r.doc_id = p.doc_id AND p.idx BETWEEN r.a AND r.b GROUP BY 1, 2)
SELECT doc_id, coalesce(label, 'core') AS label, count(*) AS n FROM l GROUP BY 1, 2"""),
    "repeated_lines": (repeated_lines, f"WITH {PARAS} SELECT text, count(DISTINCT doc_id) AS docs FROM paras GROUP BY 1 HAVING count(DISTINCT doc_id) > 0.004 * (SELECT count(DISTINCT doc_id) FROM paras)"),
    "budget_words": (budget_words, f"WITH {WORDS} SELECT doc_id, level, {_BUDGET} AS budget FROM words, {_LEVEL}"),
    "cost_estimates": (cost_estimates, None),
    "day_boundaries": (day_boundaries, """SELECT event_id, CAST(l AS DATE) AS day, CAST(epoch((CAST(CAST(l AS DATE) + 1 AS TIMESTAMP)) AT TIME ZONE 'America/Los_Angeles') AS BIGINT) AS next
FROM (SELECT event_id, (to_timestamp(floor(epoch(ts))) AT TIME ZONE 'America/Los_Angeles') AS l FROM events)"""),
    "http_outcomes": (http_outcomes, r"""
WITH e AS (SELECT event_id, [200, 429, 401, 400, 413, 500, 504, 404, 418, 429][CAST(event_id % 10 + 1 AS INT)] AS st, ['Requests per day exceeded', 'context length', 'rpm', ''][CAST(event_id % 4 + 1 AS INT)] AS msg,
  CASE WHEN event_id % 30 = 0 THEN 'length' WHEN event_id % 50 = 0 THEN 'SAFETY' END AS fr FROM events)
SELECT event_id, CASE WHEN st = 200 AND fr = 'length' THEN 'truncated' WHEN st = 200 AND fr = 'SAFETY' THEN 'safety_blocked' WHEN st = 200 THEN 'ok'
  WHEN st = 429 AND msg LIKE '%per day%' THEN 'rate_limited_day' WHEN st = 429 AND msg = 'rpm' THEN 'rate_limited_minute' WHEN st = 429 THEN 'rate_limited_unknown' WHEN st = 401 THEN 'auth_error'
  WHEN st = 413 OR st = 400 AND msg LIKE '%context%' THEN 'context_exceeded' WHEN st IN (400, 404) THEN 'bad_request' WHEN st = 504 THEN 'timeout' WHEN st >= 500 THEN 'server_error' ELSE 'bad_request' END AS outcome FROM e"""),
    "key_statuses": (key_statuses, """
WITH k AS (SELECT c_nationkey AS request, c_custkey AS pos, CASE c_custkey % 7 WHEN 0 THEN 'placeholder' WHEN 1 THEN 'too_short' WHEN 2 THEN 'invalid' ELSE 'ok' END AS st, md5(CAST(c_custkey % 700 AS VARCHAR)) AS key FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY request, st, key ORDER BY pos) AS n FROM k), x AS (SELECT md5(CAST(c_custkey + 650 AS VARCHAR)) AS key FROM customer WHERE c_custkey < 100)
SELECT pos, CASE WHEN st <> 'ok' THEN st WHEN n > 1 THEN 'duplicate_in_request' WHEN key IN (SELECT key FROM x) THEN 'duplicate_existing' ELSE 'ok' END AS status FROM n"""),
    "eligible_pairs": (eligible_pairs, """
SELECT c_custkey AS request, n_name AS deployment FROM customer c, nation n WHERE n_nationkey % 11 <> 0 AND n_nationkey % 4 > 0 AND n_nationkey % 3 >= c_custkey % 2
  AND (n_nationkey % 6 <> 0 OR n_nationkey % 12 = 0) AND (c_custkey % 5 <> 0 OR n_nationkey % 2 = 0) AND n_nationkey / 25 >= (c_custkey % 10) / 20 AND c_custkey % 3 < 2
  AND NOT (c_custkey % 3 = 1 AND n_nationkey % 6 = 0) AND (c_custkey % 4 <> 0 OR (n_nationkey % 3 = 0 AND n_nationkey % 6 <> 0)) AND (n_nationkey % 5 <> 0 OR c_custkey % 2 = 1)
  AND ceil(c_custkey * 10 * 1.1::DOUBLE) + ceil(1000 * 1.1::DOUBLE) + 256 <= n_nationkey * 1000 + 4000"""),
    "constraint_violations": (constraint_violations, """SELECT o_orderkey, rule FROM (SELECT o_orderkey, unnest([CASE WHEN NOT o_totalprice < 300000 THEN 'total_range' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status_enum' END,
  CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-4]-') THEN 'priority_format' END, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'open_implies_key' END]) AS rule FROM orders) WHERE rule IS NOT NULL"""),
    "duplicate_keys": (duplicate_keys, "SELECT lower(p_type) AS p_type, p_size, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1"),
    "pid_pairing": (pid_pairing, f"""WITH {PARAS}, s AS (SELECT doc_id || '/' || pid AS pid, idx FROM paras), t AS (SELECT pid FROM s WHERE idx % 13 <> 0 UNION ALL SELECT pid FROM s WHERE idx % 17 = 0),
n AS (SELECT pid, count(*) AS n FROM t GROUP BY 1) SELECT s.pid, CASE WHEN n.n IS NULL THEN 'missing' ELSE 'repeated' END AS problem FROM s LEFT JOIN n USING (pid) WHERE n.n IS NULL OR n.n > 1"""),
    "translations": (translations, f"""WITH {PARAS}, s AS (SELECT doc_id || '/' || pid AS pid, length(text) AS n, CASE idx % 5 WHEN 0 THEN 0 WHEN 1 THEN length(trim(substr(text, 1, 20), ' ')) ELSE length(trim(text, ' ')) END AS m FROM paras)
SELECT pid, CASE WHEN m = 0 THEN 'empty' ELSE 'length_ratio' END AS problem FROM s WHERE m = 0 OR (n >= 40 AND NOT m / n BETWEEN 0.6 AND 2.2)"""),
    "enum_drift": (enum_drift, "SELECT DISTINCT event_type AS value, 'left' AS side FROM events WHERE event_type <> 'click' UNION ALL SELECT 'refund', 'right'"),
    "block_checks": (block_checks, None),
    "citations": (citations, "SELECT l_partkey AS unit, CAST(row_number() OVER (ORDER BY min(l_orderkey * 10 + l_linenumber), l_partkey) AS INT) AS number FROM lineitem GROUP BY 1"),
    "style_chains": (style_chains, """
WITH RECURSIVE p AS (SELECT c_custkey AS core, CASE WHEN c_custkey % 50 = 7 THEN c_custkey WHEN c_custkey >= 4 THEN c_custkey // 4 END AS parent FROM customer),
r AS (SELECT core, parent AS next, [core] AS chain, CAST(NULL AS VARCHAR) AS problem FROM p
  UNION ALL SELECT r.core, CASE WHEN list_contains(chain, next) OR len(chain) >= 5 THEN NULL ELSE p.parent END, CASE WHEN list_contains(chain, next) OR len(chain) >= 5 THEN chain ELSE list_append(chain, next) END,
    CASE WHEN list_contains(chain, next) THEN 'cycle' WHEN len(chain) >= 5 THEN 'too_deep' END FROM r JOIN p ON p.core = r.next WHERE r.next IS NOT NULL)
SELECT core, CAST(len(chain) AS INT) AS depth, problem FROM r WHERE next IS NULL"""),
    "report_patches": (report_patches, """
WITH b AS (SELECT l_orderkey AS section, l_linenumber AS pos, l_orderkey || '.b' || l_linenumber AS block, min(l_returnflag) AS text FROM lineitem GROUP BY 1, 2, 3),
n AS (SELECT section, pos, 0 AS part, block, CASE WHEN pos = 2 THEN 'new' ELSE text END AS text FROM b WHERE pos <> 1 UNION ALL SELECT section, pos, 1, block || '+', 'added' FROM b WHERE pos = 3)
SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY pos, part, block) AS INT) AS pos, block, text FROM n"""),
    "grades": (grades, """
WITH g AS (SELECT l_suppkey AS report, avg(CASE WHEN l_tax < 0.08 THEN 1 ELSE 0 END) AS coverage, avg(CASE WHEN l_discount < 0.1 THEN 1 ELSE 0 END) AS faithfulness, count(*) FILTER (NOT l_quantity < 50) AS unresolved FROM lineitem GROUP BY 1)
SELECT report, round(coverage, 9) AS coverage, round(faithfulness, 9) AS faithfulness, unresolved, CASE WHEN coverage >= 0.97 AND faithfulness >= 0.98 AND unresolved = 0 THEN 'A' WHEN coverage >= 0.9 AND faithfulness >= 0.95 THEN 'B' ELSE 'C' END AS grade FROM g"""),
    "plan_checks": (plan_checks, """
WITH p AS (SELECT l_returnflag AS section, l_orderkey + CASE WHEN l_orderkey % 97 = 0 THEN 100000000 ELSE 0 END AS unit FROM lineitem)
SELECT o_orderkey AS unit, 'unassigned' AS problem FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderkey NOT IN (SELECT unit FROM p)
UNION ALL SELECT DISTINCT unit, 'unknown' FROM p WHERE unit NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT unit, 'twice' FROM p GROUP BY unit HAVING count(DISTINCT section) > 1"""),
    "extract_json": (extract_json, "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "prompt_render": (prompt_render, "SELECT n_nationkey, 'Hello ' || n_name || ' {{region}} of ' || n_regionkey || '; ' || n_name || ' {{region}}!' AS text FROM nation"),
    "daily_capacity": (daily_capacity, """
WITH r AS (SELECT p_partkey AS k, p_partkey % 37 + 1 AS b FROM part),
l AS (SELECT k, CASE WHEN k % 3 <> 0 THEN b * 50 END AS drpd, CASE WHEN k % 4 <> 0 THEN b END AS drpm, CASE WHEN k % 5 <> 0 THEN b * 10000 END AS dtpd, CASE WHEN k % 2 <> 0 THEN b * 900 END AS dtpm,
  CASE WHEN k % 2 <> 0 THEN b * 400 END AS grpd, CASE WHEN k % 6 <> 0 THEN b * 3 END AS grpm, CASE WHEN k % 7 <> 0 THEN b * 90000 END AS gtpd, CASE WHEN k % 9 <> 0 THEN b * 700 END AS gtpm FROM r)
SELECT k AS deployment, CAST(least(floor(drpd * 0.95::DOUBLE), CASE WHEN drpm IS NOT NULL THEN floor(greatest(1.0, drpm * 0.85::DOUBLE) * 1440) END, floor(grpd * 0.95::DOUBLE),
  CASE WHEN grpm IS NOT NULL THEN floor(greatest(1.0, grpm * 0.85::DOUBLE) * 1440) END) AS BIGINT) AS calls,
  CAST(least(floor(dtpd * 0.95::DOUBLE), floor(dtpm * 0.85::DOUBLE * 1440), floor(gtpd * 0.95::DOUBLE), floor(gtpm * 0.85::DOUBLE * 1440)) AS BIGINT) AS tokens FROM l"""),
}
