"""Style guides: lint, conditions of approval and open decisions, as tables of problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stages that a rule may apply to, control characters, and phrases that try to steer a prompt.
STAGES = ["map", "write", "translate", "verify", "repair"]
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
STEERING = r"(?i)\b(ignore (all|any|previous)|system prompt|json|you are now|disregard)\b"


def style_problems(items: DataFrame, stages: list[str] = STAGES) -> DataFrame:
    """``(core, path, problem)`` of a guide's items ``(core, kind, id, text, applies_to)``.

    A kind is ``rules``, ``exemplars`` or ``notes``: repeated ids, unknown stages, control characters, and in rules and
    notes phrases that steer a prompt.
    """
    path = F.concat("kind", F.lit("["), "id", F.lit("]"))
    named = items.where(F.col("kind").isin("rules", "exemplars"))
    twice = named.groupBy("core", path.alias("path")).agg(F.count("*").alias("n")).where("n > 1").select("core", "path",
        F.lit("repeated_id").alias("problem"))
    known = F.array(*map(F.lit, stages))
    strange = F.size(F.array_except(F.coalesce("applies_to", F.array().cast("array<string>")), known)) > 0
    found = [F.when(strange, "unknown_stage"), F.when(F.col("text").rlike(CONTROL), "control_character"),
             F.when(F.col("kind").isin("rules", "notes") & F.col("text").rlike(STEERING), "steers_prompt")]
    each = items.select("core", path.alias("path"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("problem"))
    return twice.unionByName(each)


def open_decisions(decisions: DataFrame, answers: DataFrame) -> DataFrame:
    """Decisions ``(core, id)`` without an answer."""
    return decisions.join(answers.select("core", "id"), ["core", "id"], "left_anti")


def approval_problems(cores: DataFrame, items: DataFrame, decisions: DataFrame, answers: DataFrame) -> DataFrame:
    """``(core, problem, n)``: what keeps guides ``(core, name)`` from approval; ``items`` also have ``origin`` and ``reviewed``."""
    parts = [
        open_decisions(decisions, answers).select("core", F.lit("open_decision").alias("problem")),
        items.where("origin = 'ai' AND NOT coalesce(reviewed, false)").select("core", F.lit("unreviewed").alias("problem")),
        style_problems(items).select("core", F.lit("style_problem").alias("problem")),
        cores.where("trim(coalesce(name, '')) = ''").select("core", F.lit("no_name").alias("problem"))]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("core", "problem").agg(F.count("*").alias("n"))


#: The severities of rules, the least important last, and the settings of each part of a style.
SEVERITIES = ("must", "should", "may")
POLICY, FORMATTING = ("first_use", "unknown_terms", "proper_names"), ("quotes", "lists", "numbers")


def compiled(cores: DataFrame, rules: DataFrame, exemplars: DataFrame, stage: str, neutral: str = "No style is set.") -> DataFrame:
    """``(core, text)``: each style as a text for a stage that fits its ``cap``.

    ``cores``: ``core, cap, register, voice_notes``, the settings of ``POLICY`` with ``policy_notes`` and of ``FORMATTING`` with
    ``formatting_notes``. ``rules``: ``core, id, severity, text, applies_to``. ``exemplars``: ``core, pos, source, target, note,
    applies_to, id``. What does not fit is rendered without the may rules, then without the should rules, with two examples, with
    none, and at last, whether it fits or not, without notes. Must rules and settings always stay. A style without anything
    says ``neutral``. A core's rules and examples are one row: it is a text for a prompt, whose size people bound.
    """
    here = F.coalesce(F.size("applies_to"), F.lit(0)) <= 0
    here |= F.array_contains("applies_to", stage)
    shown = lambda c: F.trim(F.translate(c, "<>", "‹›"))
    line = F.struct("severity", "id", F.concat(F.lit("- ["), F.col("id"), F.lit("] "), shown(F.col("text"))).alias("line"))
    held = rules.where(here).groupBy("core").agg(F.array_sort(F.collect_list(line)).alias("rules"))
    pair = F.concat(F.lit("["), F.col("id"), F.lit("] "), shown(F.col("source")), F.lit(" => "), shown(F.col("target")))
    noted = F.concat(pair, F.when(F.col("note") != "", F.concat(F.lit(" ("), shown(F.col("note")), F.lit(")"))).otherwise(""))
    pairs = exemplars.where(here).groupBy("core").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(noted, pair).alias("noted"), pair.alias("plain")))).alias("pairs"))
    rows = cores.join(held, "core", "left").join(pairs, "core", "left")

    def joined(parts: list[Column], by: str) -> Column:
        return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), by)

    def settings(title: str, names: tuple[str, ...], notes: str | None) -> Column:
        known = joined([F.when(F.col(n) != "unspecified", F.concat(F.lit(f"{n}="), F.col(n))) for n in names if n], "; ")
        after = F.when(F.col(notes) != "", F.concat(F.lit(" "), shown(F.col(notes)))).otherwise("") if notes else F.lit("")
        return F.when(known != "", F.concat(F.lit(f"{title}: "), known, F.lit("."), F.coalesce(after, F.lit(""))))

    def of_severity(severity: str) -> Column:
        return F.transform(F.filter("rules", lambda r: r["severity"] == severity), lambda r: r["line"])

    def rendered(severities: tuple[str, ...], examples: int | None, notes: bool) -> Column:
        parts = [joined([F.when(F.col("register") != "unspecified", F.concat(F.lit("Register: "), F.col("register"), F.lit("."))), *([shown(F.col("voice_notes"))] if notes else [])], " "),
                 settings("Terminology policy", POLICY, "policy_notes" if notes else None), settings("Formatting", FORMATTING, "formatting_notes" if notes else None)]
        for severity in severities:
            own = of_severity(severity)
            parts.append(F.when(F.size(own) > 0, F.concat(F.lit(f"Rules ({severity.upper()}):\n"), F.array_join(own, "\n"))))
        if examples != 0:
            own = F.transform("pairs" if examples is None else F.slice("pairs", 1, examples), lambda e: e["noted" if notes else "plain"])
            parts.append(F.when(F.size(own) > 0, F.concat(F.lit("Examples (source => target):\n"), F.array_join(own, "\n"))))
        text = joined(parts, "\n")
        return F.when(text == "", neutral).otherwise(text)

    steps = [rendered(SEVERITIES, None, True), rendered(SEVERITIES[:2], None, True), rendered(SEVERITIES[:1], None, True), rendered(SEVERITIES[:1], 2, True), rendered(SEVERITIES[:1], 0, True)]
    return rows.select("core", F.coalesce(*(F.when(F.length(t) <= F.col("cap"), t) for t in steps), rendered(SEVERITIES[:1], 0, False)).alias("text"))
