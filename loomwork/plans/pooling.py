"""Queries on schemas, declarations, shared tables, job states, stage statistics and the order of candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import declarations, glossary, policies, pool, queue, reports, schemas, styles
from loomwork.plans import tables as T
from loomwork.plans.tables import PARAS
from loomwork.sources import shared
from loomwork.sources import text as sources

SCHEMA = {
    "$defs": {
        "pid": {"type": "string", "pattern": "^P[0-9]{6,}$"},
        "evidence": {"type": "object", "required": ["pid", "quote"], "additionalProperties": False,
                     "properties": {"pid": {"$ref": "#/$defs/pid"}, "quote": {"type": "string", "minLength": 3, "maxLength": 40}}},
    },
    "type": "object", "required": ["segment", "units"], "additionalProperties": False,
    "properties": {
        "segment": {"type": "string", "pattern": "^SEG-[0-9]{3,}$"},
        "version": {"const": 2},
        "score": {"type": ["number", "null"], "minimum": 0, "maximum": 1},
        "tags": {"type": "array", "maxItems": 3, "uniqueItems": True, "items": {"type": "string"}},
        "units": {"type": "array", "minItems": 1, "items": {
            "type": "object", "required": ["id", "importance", "evidence"], "additionalProperties": False,
            "properties": {
                "id": {"type": "string", "pattern": "^U-[0-9]{4,}$"},
                "importance": {"enum": ["core", "supporting", "minor"]},
                "evidence": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/evidence"}},
                "number": {"anyOf": [{"type": "integer"}, {"type": "string", "pattern": "^[0-9]+$"}]}}}}},
}
#: The good reply, and what is changed in it with the problem that must come of it.
REPLY = ('{"segment":"SEG-001","version":2,"score":0.5,"tags":["a","b"],"units":[{"id":"U-0001","importance":"core","evidence":[{"pid":"P000001","quote":"as it says"},'
         '{"pid":"P000002","quote":"and so on"}],"number":7},{"id":"U-0002","importance":"minor","evidence":[{"pid":"P000003","quote":"once more"}],"number":"12"}]}')
MUTATIONS = [
    ('"SEG-001"', '"S1"', "$.segment", "pattern"), ('"segment":"SEG-001",', "", "$.segment", "required"), ('"SEG-001"', "5", "$.segment", "type"),
    ('"version":2', '"version":3', "$.version", "const"), ('"score":0.5', '"score":1.5', "$.score", "maximum"), ('"score":0.5', '"score":-1', "$.score", "minimum"),
    ('"score":0.5', '"score":"high"', "$.score", "type"), ('["a","b"]', '["a","b","c","d"]', "$.tags", "maxItems"), ('["a","b"]', '["a","a"]', "$.tags", "uniqueItems"),
    ('["a","b"]', '["a",4]', "$.tags[1]", "type"), ('["a","b"]', '{"a":1}', "$.tags", "type"), ('"version":2,', '"version":2,"extra":1,', "$.extra", "additionalProperties"),
    ('"U-0002"', '"u2"', "$.units[1].id", "pattern"), ('"core"', '"critical"', "$.units[0].importance", "enum"), ('"P000002"', '"P12"', "$.units[0].evidence[1].pid", "pattern"),
    ('"quote":"as it says"', '"quote":"as"', "$.units[0].evidence[0].quote", "minLength"),
    ('"once more"', '"once more, at a length that nobody would ask for"', "$.units[1].evidence[0].quote", "maxLength"),
    ('[{"pid":"P000003","quote":"once more"}]', "[]", "$.units[1].evidence", "minItems"), ('"pid":"P000003",', "", "$.units[1].evidence[0].pid", "required"),
    ('"number":7', '"number":[7]', "$.units[0].number", "anyOf"), (REPLY[-1], "", "$", "unreadable")]


def schema_conformance(spark, d):
    """A reply per order: good ones, and each way of breaking the schema."""
    reply, case = F.lit(REPLY), F.col("o_orderkey") % (len(MUTATIONS) + 2)
    for i, (old, new, _, _) in enumerate(MUTATIONS[:-1], 2):
        reply = F.when(case == i, F.lit(REPLY.replace(old, new))).otherwise(reply)
    reply = F.when(case == len(MUTATIONS) + 1, F.lit(REPLY[:-1])).otherwise(reply)
    other = F.replace(reply, F.lit('"number":"12"'), F.concat(F.lit('"number":"'), F.col("o_custkey"), F.lit('"')))
    rows = T.table(spark, d, "orders").select("o_orderkey", other.alias("reply"))
    return schemas.schema_problems(rows, "o_orderkey", "reply", SCHEMA)


def _keys(spark, d):
    """Customers as keys of declarations, some of which another one has too."""
    c = T.table(spark, d, "customer")
    k = F.col("c_custkey")
    finger = F.when(k % 10 == 3, k - 2).when(k % 100 == 7, k % 1000).otherwise(k).cast("string")
    label = F.when(k % 4 == 0, F.concat(F.lit("team"), k % 3))
    return c.select((k % 25).alias("declaration"), k.alias("pos"), finger.alias("fingerprint"), label.alias("label"), F.when(k % 9 == 0, "too_short").otherwise("ok").alias("status"))


def _declared(spark, d):
    n = T.table(spark, d, "nation")
    k = F.col("n_nationkey")
    none = F.array().cast("array<string>")
    decl = n.select(k.alias("declaration"), F.concat(F.lit("p"), F.col("n_regionkey")).alias("provider"), F.element_at(F.array(*map(F.lit, ("free", "trial", "paid"))), (k % 3 + 1).cast("int")).alias("tier"),
                    F.when(k % 4 == 1, "single_group").otherwise("per_key").alias("mode"), none.alias("tos_flags"),
                    F.when(k % 2 == 0, F.array(F.lit("multi_account_risk"), F.lit("trial_only"))).otherwise(none).alias("risk_ack"))
    groups = n.where("n_nationkey % 5 = 0").select(F.concat(F.lit("p"), F.col("n_regionkey"), F.lit("-free-"), k + 1).alias("group_id"), F.concat(F.lit("p"), F.col("n_regionkey")).alias("provider"),
                                                  F.lit("free").alias("tier"), none.alias("tos_flags"), none.alias("risk_ack"))
    known = T.table(spark, d, "supplier").where("s_suppkey % 50 = 0").select(F.col("s_suppkey").cast("string").alias("fingerprint"))
    return decl, groups, known


def declared_keys(spark, d):
    return declarations.judged(_keys(spark, d), _declared(spark, d)[2]).select("declaration", "pos", "status")


def declared_groups_derived(spark, d):
    decl, groups, known = _declared(spark, d)
    plan = declarations.planned(declarations.judged(_keys(spark, d), known), decl, groups)
    rows = declarations.derived(plan, decl, groups)
    return rows.select("declaration", "group_id", "new", F.array_join("tos_flags", ",").alias("flags"), F.array_join("allowed_gates", ",").alias("gates"), "problem")


def declaration_preview(spark, d):
    decl, groups, known = _declared(spark, d)
    keys = declarations.judged(_keys(spark, d), known)
    plan = declarations.planned(keys, decl, groups)
    return declarations.preview(keys, plan, declarations.derived(plan, decl, groups))


def tables_applied(spark, d):
    """Suppliers and nations put into two tables in two changes, the second of which is applied twice."""
    root = shared.folder(spark, "applied")
    n, s = T.table(spark, d, "nation"), T.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    shared.applied(spark, root, "first", {"providers": (n.where("n_nationkey < 10").select("n_nationkey", "n_name"), "n_nationkey"), "groups": (s.where("s_nationkey < 10"), "s_suppkey")})
    for _ in range(2):
        shared.applied(spark, root, "second", {"providers": (n.select("n_nationkey", "n_name"), "n_nationkey"), "groups": (s.where("s_nationkey > 5"), "s_suppkey")})
    state = shared.manifest(spark, root)
    counts = [(change, table, count) for change, tables in state["applied"].items() for table, count in tables.items()]
    held = shared.current(spark, root, "groups", s.schema, state).select(F.lit("held").alias("change"), F.concat(F.lit("groups/"), "s_suppkey").alias("name"), F.lit(1).cast("long").alias("n"))
    return held.unionByName(spark.createDataFrame(counts, "change string, name string, n long"))


def call_log(spark, d):
    """Calls appended in three batches, one of which comes again."""
    path = shared.folder(spark, "calls")
    calls = T.table(spark, d, "events").select("event_id", "user_id", "value", F.to_date("ts").alias("day"))
    for batch in (0, 1, 2, 1):
        shared.logged(calls.where(F.col("event_id") % 3 == batch), batch, path)
    rows = spark.read.schema("event_id long, user_id long, value double, batch long, day date").parquet(path)
    return rows.groupBy("day", "batch").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


def glossary_files(spark, d):
    """A glossary written as CSV and read again."""
    p = T.table(spark, d, "part").groupBy(F.col("p_name").alias("source_term")).agg(F.min("p_partkey").alias("k"), F.min("p_brand").alias("brand"))
    none = F.lit(None).cast("string")
    entries = p.select("source_term", F.concat(F.lit('the "'), "brand", F.lit('", so')).alias("target_term"), (F.col("k") % 2 == 0).alias("keep_original"), (F.col("k") % 3 == 0).alias("case_sensitive"),
                       F.when(F.col("k") % 5 == 0, F.array(F.col("brand"), F.lit("x y"))).otherwise(F.array().cast("array<string>")).alias("forbidden_variants"),
                       F.lit("noun").alias("term_type"), none.alias("note"))
    path = shared.folder(spark, "glossary")
    sources.write_glossary(entries, path)
    rows = sources.read_glossary(spark, path)
    return rows.select("source_term", "target_term", "keep_original", "case_sensitive", F.array_join("forbidden_variants", "|").alias("variants"))


def backed_up_tables(spark, d):
    """Tables that a backup has, by their rows read again; paragraphs are not among them."""
    path = shared.folder(spark, "backup")
    tables = {"suppliers": T.table(spark, d, "supplier"), "nations": T.table(spark, d, "nation"), "doc_paragraphs": T.paras(spark, d)}
    names = queue.back_up(tables, path)
    rows = [spark.read.schema(tables[n].schema).parquet(f"{path}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def prompt_files(spark, d):
    """Prompts written as files and read again."""
    path = shared.folder(spark, "prompts")
    n = T.table(spark, d, "nation")
    text = F.concat(F.lit("---\nid: "), "n_nationkey", F.lit("\n---\n## SYSTEM\nYou are of "), "n_name", F.lit(".\n## USER\n  {{text}} "), "n_regionkey", F.lit("\n")).alias("value")
    n.select(text, F.col("n_nationkey").cast("string").alias("k")).repartition("k").write.partitionBy("k").text(path)
    return sources.prompts(spark, f"{path}/*/*.txt").select("front", "system", "user")


def job_states(spark, d):
    """Events of a user as states of a job: some in a legal order, some not."""
    e = T.table(spark, d, "events")
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "awaiting_glossary", "running", "succeeded", "expired", "failed", "canceled"))), (F.col("event_id") % 8 + 1).cast("int"))
    log = e.select(F.floor(F.col("event_id") / 8).alias("job_id"), F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), status.alias("status"))
    return queue.job_moves(log.where("seq % 13 > 0"), 3600).select("job_id", "seq", "was", "legal")


def stage_advance(spark, d):
    i = T.table(spark, d, "lineitem")
    k = F.col("l_orderkey") + F.col("l_linenumber")
    status = F.when((F.col("l_orderkey") % 4 == 0) & (F.col("l_linenumber") > 2) | (F.col("l_linenumber") > 3), "pending").when(k % 11 == 0, "running").when(k % 5 == 0, "skipped").otherwise("succeeded")
    stages = i.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("n"), F.concat(F.lit("stage"), F.col("l_linenumber")).alias("stage"), status.alias("status"))
    return queue.next_stages(stages)


def stage_stats(spark, d):
    p = T.paras(spark, d)
    k = F.col("doc_id") + F.col("idx")
    units = p.select("doc_id", F.when(F.col("idx") % 3 == 0, "core").otherwise("minor").alias("importance"), F.when(k % 5 == 0, "omitted").when(k % 7 == 0, "merged").otherwise("used").alias("state"),
                     F.when(k % 10 == 0, "duplicate").when(k % 5 == 0, "off_topic").alias("reason"))
    return policies.stage_stats(units)


def source_shares(spark, d):
    p = T.paras(spark, d)
    label = F.element_at(F.array(*map(F.lit, ("core", "example", "qa", "anecdote", "aside", "admin"))), (F.col("idx") % 6 + 1).cast("int"))
    rows = p.select("doc_id", label.alias("label"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    return policies.source_shares(rows).select("doc_id", "label", "paragraphs", "words", F.round("share", 6).alias("share"))


def section_plans(spark, d):
    """Orders as plans, their lines as sections."""
    i, o = T.table(spark, d, "lineitem"), T.table(spark, d, "orders")
    k = F.col("l_orderkey")
    place = F.when((k % 9 == 0) & (F.col("l_linenumber") == 3), 2).otherwise(F.col("l_linenumber"))
    kind = F.when((F.col("l_linenumber") == 1) & (k % 5 > 0), "summary").otherwise("body")
    sections = i.select(k.alias("plan"), place.alias("pos"), kind.alias("kind"), F.col("l_quantity").cast("long").alias("budget"))
    words = o.select(F.col("o_orderkey").alias("plan"), (F.col("o_orderkey") % 200 + 20).alias("words"))
    return reports.section_problems(sections, words, 2, 6)


def glossary_versions(spark, d):
    """Parts as entries; glossaries that were released before get the next version."""
    p = T.table(spark, d, "part").groupBy(F.col("p_brand").alias("glossary"), F.col("p_type").alias("source_term")).agg(F.min("p_name").alias("target_term"), F.min("p_size").alias("n"))
    entries = p.withColumns({"keep_original": F.col("n") % 2 == 0, "status": F.when(F.col("n") % 3 == 0, "suggested").otherwise("confirmed")})
    now = glossary.release(entries).select("glossary", "content_sha256")
    odd = F.length("glossary") + F.ascii(F.right("glossary", F.lit(1)))
    past = now.where(odd % 3 > 0).select("glossary", (odd % 4 + 1).cast("int").alias("version"), F.when(odd % 2 == 0, F.col("content_sha256")).otherwise("other").alias("content_sha256"))
    older = past.select("glossary", F.lit(0).alias("version"), F.lit("old").alias("content_sha256"))
    return glossary.next_release(entries, past.unionByName(older)).select("glossary", "version", "changed", "entry_count")


def styles_compiled(spark, d):
    """Customers as styles of different room, orders as their rules, and lines as examples."""
    c, o, i = T.table(spark, d, "customer"), T.table(spark, d, "orders"), T.table(spark, d, "lineitem")
    k = F.col("c_custkey")
    setting = lambda n: F.when(k % n == 0, "unspecified").otherwise("same")
    cores = c.select(k.alias("core"), (k % 9 * 150 + 100).alias("cap"), setting(2).alias("register"), F.when(k % 3 == 0, "Speak <plainly>").alias("voice_notes"), setting(3).alias("first_use"),
                     setting(5).alias("unknown_terms"), F.lit("unspecified").alias("proper_names"), F.when(k % 4 == 0, "as it is").alias("policy_notes"), setting(1).alias("quotes"), setting(7).alias("lists"),
                     setting(7).alias("numbers"), F.lit("").alias("formatting_notes"))
    severity = F.element_at(F.array(*map(F.lit, styles.SEVERITIES)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    to = F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("map"))).when(F.col("o_orderkey") % 7 == 1, F.array(F.lit("write"), F.lit("map")))
    rules = o.select(F.col("o_custkey").alias("core"), F.format_string("R%08d", "o_orderkey").alias("id"), severity.alias("severity"), F.concat(F.lit("<"), "o_orderpriority", F.lit(">")).alias("text"), to.alias("applies_to"))
    n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    pairs = i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("core"), n.alias("pos")).agg(
        F.min("l_returnflag").alias("source"), F.min("l_linestatus").alias("target"))
    pairs = pairs.withColumns({"id": F.concat(F.lit("E"), "pos"), "note": F.when(F.col("pos") % 3 == 0, "so"), "applies_to": F.array().cast("array<string>")})
    return styles.compiled(cores, rules, pairs, "write").select("core", F.length("text").alias("n"), F.md5("text").alias("md5"))


def _candidates(spark, d):
    i = T.table(spark, d, "lineitem")
    rows = i.groupBy(F.col("l_orderkey").alias("request"), (F.col("l_suppkey") % 20).alias("deployment")).agg(F.min("l_linenumber").alias("n"))
    return rows.select("request", "deployment", (F.col("n") * 0.25).alias("score"))


def weighted_order(spark, d):
    return pool.shuffled(_candidates(spark, d)).select("request", "deployment", "place")


def two_choices(spark, d):
    return pool.two_choices(_candidates(spark, d)).select("request", "deployment", "place")


_DECLARED = """
c AS (SELECT c_custkey AS k FROM customer),
keys AS (SELECT k % 25 AS declaration, k AS pos, CAST(CASE WHEN k % 10 = 3 THEN k - 2 WHEN k % 100 = 7 THEN k % 1000 ELSE k END AS VARCHAR) AS f,
  CASE WHEN k % 4 = 0 THEN 'team' || k % 3 END AS label, CASE WHEN k % 9 = 0 THEN 'too_short' ELSE 'ok' END AS st FROM c),
known AS (SELECT CAST(s_suppkey AS VARCHAR) AS f FROM supplier WHERE s_suppkey % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY f, st ORDER BY declaration, pos) AS r, row_number() OVER (PARTITION BY f, st, declaration ORDER BY pos) AS o FROM keys),
judged AS (SELECT *, CASE WHEN st <> 'ok' THEN st WHEN f IN (SELECT f FROM known) THEN 'duplicate_existing' WHEN o > 1 THEN 'duplicate_in_request'
  WHEN r > 1 THEN 'duplicate_across' ELSE 'ok' END AS status FROM ranked),
decl AS (SELECT n_nationkey AS declaration, 'p' || n_regionkey AS provider, ['free', 'trial', 'paid'][n_nationkey % 3 + 1] AS tier,
  CASE WHEN n_nationkey % 4 = 1 THEN 'single_group' ELSE 'per_key' END AS mode, n_nationkey % 2 = 0 AS acked FROM nation),
old AS (SELECT 'p' || n_regionkey || '-free-' || (n_nationkey + 1) AS group_id, 'p' || n_regionkey AS provider, n_nationkey + 1 AS n FROM nation WHERE n_nationkey % 5 = 0),
good AS (SELECT j.*, d.provider, d.tier, d.mode, d.acked, d.provider || '-' || d.tier AS stem, d.mode <> 'single_group' AND j.label IS NULL AS loose FROM judged j JOIN decl d USING (declaration) WHERE j.status = 'ok'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY stem, loose ORDER BY declaration, pos)
  + coalesce((SELECT max(n) FROM old WHERE old.provider || '-free' = good.stem), 0) AS n FROM good),
plan AS (SELECT declaration, provider, tier, acked, CASE WHEN mode = 'single_group' THEN stem WHEN label IS NOT NULL THEN stem || '-' || label ELSE stem || '-' || n END AS group_id FROM numbered),
g0 AS (SELECT DISTINCT * FROM plan),
g1 AS (SELECT *, group_id NOT IN (SELECT group_id FROM old) AND row_number() OVER (PARTITION BY group_id ORDER BY declaration) = 1 AS new FROM g0),
g2 AS (SELECT *, CASE WHEN tier = 'free' THEN (SELECT count(*) FROM old WHERE old.provider = g1.provider) ELSE 0 END
  + sum(CAST(new AS INT)) OVER (PARTITION BY provider, tier ORDER BY declaration RANGE UNBOUNDED PRECEDING) AS have FROM g1),
g3 AS (SELECT *, tier IN ('free', 'trial') AND have >= 2 AS multi, tier = 'trial' AS trial FROM g2),
derived AS (SELECT declaration, group_id, new,
  concat_ws(',', CASE WHEN multi THEN 'multi_account_risk' END, CASE WHEN trial THEN 'no_personal_data,trial_only' END) AS flags,
  CASE WHEN trial THEN 'dev' WHEN multi THEN 'dev,A' ELSE 'dev,A,B,C' END AS gates,
  CASE WHEN (multi OR trial) AND NOT acked THEN 'risk_not_accepted ' || concat_ws(',', CASE WHEN multi THEN 'multi_account_risk' END, CASE WHEN trial THEN 'trial_only' END) END AS problem FROM g3)"""



def _style(severities: str, examples: int | None, notes: bool) -> str:
    pairs = f"Examples (source => target):' || chr(10) || array_to_string({'pairs' if examples is None else f'pairs[1:{examples}]'}, chr(10))"
    parts = ["nullif(concat_ws(' ', CASE WHEN register THEN 'Register: same.' END" + (", voice" if notes else "") + "), '')",
             "CASE WHEN first_use OR unknown THEN 'Terminology policy: ' || concat_ws('; ', CASE WHEN first_use THEN 'first_use=same' END, CASE WHEN unknown THEN 'unknown_terms=same' END) || '.'"
             + (" || coalesce(' ' || policy, '')" if notes else "") + " END",
             "CASE WHEN lists THEN 'Formatting: lists=same; numbers=same.' END"]
    parts += [f"'Rules ({s}):' || chr(10) || rules_{s}" for s in severities.split()]
    parts += [f"CASE WHEN len(pairs) > 0 THEN '{pairs} END"] if examples != 0 else []
    return f"coalesce(nullif(concat_ws(chr(10), {', '.join(parts)}), ''), 'No style is set.')"


_DRAW = "(CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"
_CANDIDATES = 'c AS (SELECT l_orderkey AS request, l_suppkey % 20 AS deployment, min(l_linenumber) * 0.25 AS score FROM lineitem GROUP BY 1, 2)'

QUERIES = {
    "schema_conformance": (schema_conformance, "SELECT o_orderkey, path, problem FROM orders JOIN (VALUES " + ", ".join(
        f"({i}, '{path}', '{problem}')" for i, (_, _, path, problem) in enumerate(MUTATIONS, 2)) + f") AS v(m, path, problem) ON o_orderkey % {len(MUTATIONS) + 2} = m"),
    "declared_keys": (declared_keys, f"WITH {_DECLARED} SELECT declaration, pos, status FROM judged"),
    "declared_groups_derived": (declared_groups_derived, f"WITH {_DECLARED} SELECT * FROM derived"),
    "declaration_preview": (declaration_preview, f"""WITH {_DECLARED},
k AS (SELECT declaration, count(*) FILTER (status = 'ok') AS keys, count(*) FILTER (status <> 'ok') AS skipped_keys, count(*) FILTER (status = 'duplicate_across') AS a FROM judged GROUP BY 1),
g AS (SELECT declaration, count(*) AS groups, count(*) FILTER (new) AS new_groups, count(problem) AS o FROM derived GROUP BY 1)
SELECT k.declaration, coalesce(groups, 0) AS groups, coalesce(new_groups, 0) AS new_groups, keys, skipped_keys, a + coalesce(o, 0) + CASE WHEN keys = 0 THEN 1 ELSE 0 END AS errors
FROM k LEFT JOIN g USING (declaration)"""),
    "tables_applied": (tables_applied, """
SELECT 'held' AS change, 'groups/' || s_suppkey AS name, CAST(1 AS BIGINT) AS n FROM supplier
UNION ALL SELECT 'first', 'providers', count(*) FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 'second', 'providers', count(*) FROM nation WHERE n_nationkey >= 10
UNION ALL SELECT 'first', 'groups', count(*) FROM supplier WHERE s_nationkey < 10 UNION ALL SELECT 'second', 'groups', count(*) FROM supplier WHERE s_nationkey >= 10"""),
    "call_log": (call_log, "SELECT CAST(ts AS DATE) AS day, CAST(event_id % 3 AS BIGINT) AS batch, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1, 2"),
    "glossary_files": (glossary_files, """
WITH p AS (SELECT p_name AS source_term, min(p_partkey) AS k, min(p_brand) AS brand FROM part GROUP BY 1)
SELECT source_term, 'the "' || brand || '", so' AS target_term, k % 2 = 0 AS keep_original, k % 3 = 0 AS case_sensitive, CASE WHEN k % 5 = 0 THEN brand || '|x y' ELSE '' END AS variants FROM p"""),
    "backed_up_tables": (backed_up_tables, "SELECT 'suppliers' AS name, count(*) AS n FROM supplier UNION ALL SELECT 'nations', count(*) FROM nation"),
    "prompt_files": (prompt_files, """
SELECT 'id: ' || n_nationkey AS front, 'You are of ' || n_name || '.' AS system, '{{text}} ' || n_regionkey AS "user" FROM nation"""),
    "job_states": (job_states, """
WITH l AS (SELECT event_id // 8 AS job_id, event_id AS seq, ts, ['queued', 'running', 'awaiting_glossary', 'running', 'succeeded', 'expired', 'failed', 'canceled'][event_id % 8 + 1] AS status
  FROM events WHERE event_id % 13 > 0),
w AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY floor(epoch(ts)), seq) AS was FROM l)
SELECT job_id, seq, was, coalesce(CASE WHEN was IS NULL THEN status = 'queued' WHEN was = 'queued' THEN status IN ('running', 'failed', 'canceled')
  WHEN was = 'running' THEN status IN ('awaiting_glossary', 'succeeded', 'failed', 'canceled') WHEN was = 'awaiting_glossary' THEN status IN ('running', 'failed', 'canceled')
  WHEN was IN ('succeeded', 'failed', 'canceled') THEN status = 'expired' END, false) AS legal FROM w"""),
    "stage_advance": (stage_advance, """
WITH s AS (SELECT l_orderkey AS job_id, l_linenumber AS n, CASE WHEN l_orderkey % 4 = 0 AND l_linenumber > 2 OR l_linenumber > 3 THEN 'pending' WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN 'running'
  WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN 'skipped' ELSE 'succeeded' END AS status FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n) AS r FROM s WHERE status NOT IN ('succeeded', 'skipped'))
SELECT job_id, 'stage' || n AS stage FROM o WHERE r = 1 AND status = 'pending'"""),
    "stage_stats": (stage_stats, f"""WITH {PARAS},
u AS (SELECT doc_id, CASE WHEN idx % 3 = 0 THEN 'core' ELSE 'minor' END AS importance, CASE WHEN (doc_id + idx) % 5 = 0 THEN 'omitted' WHEN (doc_id + idx) % 7 = 0 THEN 'merged' ELSE 'used' END AS state,
  CASE WHEN (doc_id + idx) % 10 = 0 THEN 'duplicate' WHEN (doc_id + idx) % 5 = 0 THEN 'off_topic' END AS reason FROM paras)
SELECT doc_id, 'importance' AS "by", importance, NULL AS state, NULL AS reason, count(*) AS n FROM u GROUP BY doc_id, importance
UNION ALL SELECT doc_id, 'state', NULL, state, NULL, count(*) FROM u GROUP BY doc_id, state
UNION ALL SELECT doc_id, 'importance,state', importance, state, NULL, count(*) FROM u GROUP BY doc_id, importance, state
UNION ALL SELECT doc_id, 'reason', NULL, NULL, reason, count(*) FROM u WHERE reason IS NOT NULL GROUP BY doc_id, reason"""),
    "source_shares": (source_shares, f"""WITH {PARAS},
u AS (SELECT doc_id, ['core', 'example', 'qa', 'anecdote', 'aside', 'admin'][idx % 6 + 1] AS label, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM paras),
s AS (SELECT doc_id, label, count(*) AS paragraphs, CAST(sum(words) AS BIGINT) AS words FROM u GROUP BY 1, 2)
SELECT *, round(CASE WHEN sum(words) OVER (PARTITION BY doc_id) > 0 THEN words / CAST(sum(words) OVER (PARTITION BY doc_id) AS DOUBLE) ELSE 0 END, 6) AS share FROM s"""),
    "section_plans": (section_plans, """
WITH s AS (SELECT l_orderkey AS plan, CASE WHEN l_orderkey % 9 = 0 AND l_linenumber = 3 THEN 2 ELSE l_linenumber END AS pos, l_linenumber = 1 AND l_orderkey % 5 > 0 AS summary,
  CAST(l_quantity AS BIGINT) AS budget FROM lineitem),
a AS (SELECT o_orderkey AS plan, o_orderkey % 200 + 20 AS words, coalesce(n, 0) AS n, places, coalesce(first, false) AS first, coalesce(b, 0) AS b FROM orders LEFT JOIN (
  SELECT plan, count(*) AS n, count(DISTINCT pos) AS places, arg_min(summary, pos) AS first, sum(budget) AS b FROM s GROUP BY plan) x ON x.plan = o_orderkey)
SELECT plan, 'few_sections' AS problem FROM a WHERE n < 2 UNION ALL SELECT plan, 'many_sections' FROM a WHERE n > 6 UNION ALL SELECT plan, 'no_summary_first' FROM a WHERE NOT first
UNION ALL SELECT plan, 'repeated_place' FROM a WHERE places < n UNION ALL SELECT plan, 'budget' FROM a WHERE abs(b - words) > words * 0.15::DOUBLE"""),
    "glossary_versions": (glossary_versions, """
WITH p AS (SELECT p_brand AS glossary, p_type AS s, min(p_size) AS n FROM part GROUP BY 1, 2),
g AS (SELECT glossary, CAST(count(*) AS INT) AS entry_count, length(glossary) + ascii(right(glossary, 1)) AS odd FROM p WHERE n % 3 > 0 GROUP BY 1)
SELECT glossary, CAST(CASE WHEN odd % 3 > 0 THEN odd % 4 + 2 ELSE 1 END AS INT) AS version, NOT (odd % 3 > 0 AND odd % 2 = 0) AS changed, entry_count FROM g"""),
    "styles_compiled": (styles_compiled, f"""
WITH c AS (SELECT c_custkey AS core, c_custkey % 9 * 150 + 100 AS cap, c_custkey % 2 > 0 AS register, CASE WHEN c_custkey % 3 = 0 THEN 'Speak ‹plainly›' END AS voice, c_custkey % 3 > 0 AS first_use,
  c_custkey % 5 > 0 AS unknown, CASE WHEN c_custkey % 4 = 0 THEN 'as it is' END AS policy, c_custkey % 7 > 0 AS lists FROM customer),
r AS (SELECT o_custkey AS core, o_orderkey % 3 AS s, o_orderkey AS k, printf('- [R%08d] ‹%s›', o_orderkey, o_orderpriority) AS l FROM orders WHERE o_orderkey % 7 > 0),
ra AS (SELECT core, string_agg(l, chr(10) ORDER BY k) FILTER (s = 0) AS rules_MUST, string_agg(l, chr(10) ORDER BY k) FILTER (s = 1) AS rules_SHOULD,
  string_agg(l, chr(10) ORDER BY k) FILTER (s = 2) AS rules_MAY FROM r GROUP BY core),
n AS (SELECT o_custkey AS core, l_orderkey * 10 + l_linenumber AS k, min(l_returnflag) AS f, min(l_linestatus) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
e AS (SELECT core, list('[E' || k || '] ' || f || ' => ' || t || CASE WHEN k % 3 = 0 THEN ' (so)' ELSE '' END ORDER BY k) AS pairs FROM n GROUP BY 1),
x AS (SELECT c.*, rules_MUST, rules_SHOULD, rules_MAY, coalesce(pairs, []) AS pairs FROM c LEFT JOIN ra ON ra.core = c.core LEFT JOIN e ON e.core = c.core),
v AS (SELECT core, cap, {_style('MUST SHOULD MAY', None, True)} AS a, {_style('MUST SHOULD', None, True)} AS b, {_style('MUST', None, True)} AS d, {_style('MUST', 2, True)} AS f,
  {_style('MUST', 0, True)} AS g, {_style('MUST', 0, False)} AS h FROM x),
t AS (SELECT core, CASE WHEN length(a) <= cap THEN a WHEN length(b) <= cap THEN b WHEN length(d) <= cap THEN d WHEN length(f) <= cap THEN f WHEN length(g) <= cap THEN g ELSE h END AS t FROM v)
SELECT core, CAST(length(t) AS INT) AS n, md5(t) AS md5 FROM t"""),
    "weighted_order": (weighted_order, f"""WITH {_CANDIDATES},
k AS (SELECT *, -ln({_DRAW.format(key="'pool-1:' || request || ':' || deployment")}) / score AS key FROM c)
SELECT request, deployment, CAST(row_number() OVER (PARTITION BY request ORDER BY key, deployment) AS INT) AS place FROM k"""),
    "two_choices": (two_choices, f"""WITH {_CANDIDATES},
o AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, deployment) AS place, count(*) OVER (PARTITION BY request) AS n FROM c),
t AS (SELECT request, max(score) FILTER (place = 1) AS a, max(score) FILTER (place = 2) AS b FROM o GROUP BY 1)
SELECT o.request, deployment, CAST(CASE WHEN n > 2 AND place <= 2 AND {_DRAW.format(key="'pool-1:' || o.request")} * (a + b) > a THEN 3 - place ELSE place END AS INT) AS place
FROM o JOIN t ON o.request = t.request"""),
}
