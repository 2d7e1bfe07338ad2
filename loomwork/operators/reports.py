"""Reports: blocks, citations, patches, plans, grades and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import marked_share
from loomwork.operators.scale import dense_numbers

# Fixed patterns of texts that must not reach a report.
LEAKED_ID = r"\b(?:U-\d{4,}|P\d{6,}|SEG-\d{3,})\b"
ASSISTANT = r"(?i)\bas an ai\b|\bi cannot\b|\bhere is the\b|\bcertainly[,!]"
MARKUP = r"(?i)</?[a-z][^>]*>|https?://"


def citation_numbers(cites: DataFrame) -> DataFrame:
    """``(unit, number)``: units of ``(pos, unit)`` numbered by their first appearance."""
    first = cites.groupBy("unit").agg(F.min("pos").alias("pos"))
    return dense_numbers(first, ["pos", "unit"], "number").select("unit", F.col("number").cast("int").alias("number"))


def numbered(rows: DataFrame, pattern: str, *order: str) -> DataFrame:
    """Rows with ``id``, dense numbers in the order given in a format such as U-%04d."""
    return dense_numbers(rows, list(order), "_n").withColumn("id", F.format_string(pattern, F.col("_n"))).drop("_n")


def patched(blocks: DataFrame, replace: DataFrame, insert_after: DataFrame, delete: DataFrame) -> DataFrame:
    """Blocks ``(section, pos, block, text)`` after replacements ``(block, text)``, insertions ``(after_block, block, text)`` and deletions ``(block)``."""
    new = replace.select("block", F.col("text").alias("_text"))
    kept = blocks.join(new, "block", "left").withColumn("text", F.coalesce("_text", "text")).drop("_text").withColumn("_part", F.lit(0))
    places = blocks.select("section", "pos", F.col("block").alias("after_block"))
    added = insert_after.join(places, "after_block").select("section", "pos", "block", "text", F.lit(1).alias("_part"))
    rows = kept.join(delete, "block", "left_anti").unionByName(added)
    pos = F.row_number().over(Window.partitionBy("section").orderBy("pos", "_part", "block"))
    return rows.withColumn("_pos", pos).select("section", F.col("_pos").alias("pos"), "block", "text")


def block_problems(blocks: DataFrame, key: str, budget: str | None = None) -> DataFrame:
    """``(key, problem)`` of block texts: leaked ids, an assistant's phrases, markup, too few marked letters, length off its budget."""
    text = F.col("text")
    found = [F.when(text.rlike(LEAKED_ID), "leaked_id"), F.when(text.rlike(ASSISTANT), "assistant_phrase"), F.when(text.rlike(MARKUP), "markup"),
             F.when((F.length(text) > 200) & (marked_share(text) < 0.12), "few_diacritics")]
    if budget:
        words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
        found.append(F.when(F.abs(words - F.col(budget)) > F.col(budget) * 0.35, "length"))
    return blocks.select(key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("problem"))


def plan_problems(plan: DataFrame, units: DataFrame) -> DataFrame:
    """``(unit, problem)`` of plans ``(section, unit)`` over units ``(unit, importance)``: unassigned core, unknown, in two sections."""
    known = units.select("unit", "importance")
    core = known.where("importance = 'core'").join(plan, "unit", "left_anti").select("unit", F.lit("unassigned").alias("problem"))
    unknown = plan.join(known, "unit", "left_anti").select("unit", F.lit("unknown").alias("problem")).distinct()
    twice = plan.groupBy("unit").agg(F.count_distinct("section").alias("n")).where("n > 1").select("unit", F.lit("twice").alias("problem"))
    return core.unionByName(unknown).unionByName(twice)


def section_problems(sections: DataFrame, budgets: DataFrame, fewest: int = 4, most: int = 20, slack: float = 0.15) -> DataFrame:
    """``(plan, problem)`` of sections ``(plan, pos, kind, budget)``: too few or many, a first one that is no summary, places that
    repeat, and budgets of words that add up to more or less than the plan's ``(plan, words)`` by the slack. A plan without sections has too few."""
    of = sections.groupBy("plan").agg(
        F.count("*").alias("n"), F.count_distinct("pos").alias("places"), F.min_by("kind", "pos").alias("first"), F.sum("budget").alias("sum"))
    rows = budgets.join(of, "plan", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "sum": F.coalesce("sum", F.lit(0))})
    found = [F.when(F.col("n") < fewest, "few_sections"), F.when(F.col("n") > most, "many_sections"), F.when(~F.col("first").eqNullSafe(F.lit("summary")), "no_summary_first"),
             F.when(F.col("places") < F.col("n"), "repeated_place"), F.when(F.abs(F.col("sum") - F.col("words")) > F.col("words") * slack, "budget")]
    return rows.select("plan", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("problem"))


def grades(checks: DataFrame) -> DataFrame:
    """``(report, coverage, faithfulness, unresolved, grade)`` of ``(report, covered, faithful, resolved)`` rows of booleans."""
    rows = checks.groupBy("report").agg(
        F.avg(F.col("covered").cast("int")).alias("coverage"), F.avg(F.col("faithful").cast("int")).alias("faithfulness"),
        F.count_if(~F.col("resolved")).alias("unresolved"))
    grade = F.when((F.col("coverage") >= 0.97) & (F.col("faithfulness") >= 0.98) & (F.col("unresolved") == 0), "A")
    return rows.withColumn("grade", grade.when((F.col("coverage") >= 0.9) & (F.col("faithfulness") >= 0.95), "B").otherwise("C"))


def release_gate(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """``(suite, problem)``: coverage down by 0.03, faithfulness by 0.02, cost up by a fifth, p95 by three tenths, or more."""
    old = baseline.select("suite", *(F.col(c).alias(f"_{c}") for c in ("coverage", "faithfulness", "cost", "p95")))
    rows = current.join(old, "suite")
    found = [F.when(F.col("_coverage") - F.col("coverage") > 0.03, "coverage"),
        F.when(F.col("_faithfulness") - F.col("faithfulness") > 0.02, "faithfulness"),
             F.when(F.col("cost") > F.col("_cost") * 1.2, "cost"), F.when(F.col("p95") > F.col("_p95") * 1.3, "p95")]
    return rows.select("suite", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("problem"))


def usage(jobs: DataFrame) -> DataFrame:
    """Per day of ``(day, status, grade, cost)``: jobs, successes, failures, cost and grades."""
    return jobs.groupBy("day").agg(
        F.count("*").alias("jobs"), F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("cost").alias("cost"), *(F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABC"))


def bullets(units: DataFrame) -> DataFrame:
    """``(section, text)``: a section as a list of its units' statements, for when writing failed."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "statement"))), lambda x: F.concat(F.lit("- "), x["statement"]))
    return units.groupBy("section").agg(F.array_join(lines, "\n").alias("text"))


def markdown_table(rows: DataFrame, order: str) -> DataFrame:
    """One row ``text``: a small result as a Markdown table."""
    names = rows.columns
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names)), F.lit(" |"))
    body = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    head = f"| {' | '.join(names)} |\n| {' | '.join('---' for _ in names)} |\n"
    return rows.agg(F.concat(F.lit(head), F.array_join(body, "\n")).alias("text"))


def rendered(template: Column, variables: Column) -> Column:
    """A template with {{name}} replaced by a map's values in a single pass: what is put in is never expanded again."""
    literal = F.split(template, r"\{\{\s*[a-zA-Z0-9_]+\s*\}\}", -1)
    names = F.regexp_extract_all(template, F.lit(r"\{\{\s*([a-zA-Z0-9_]+)\s*\}\}"), F.lit(1))
    value = lambda n: F.coalesce(F.element_at(variables, n), F.raise_error(F.concat(F.lit("missing variable "), n)))
    return F.array_join(F.zip_with(literal, names, lambda s, n: F.concat(s, F.when(n.isNull(), "").otherwise(value(n)))), "")


def inherited(cores: DataFrame, most: int = 5) -> DataFrame:
    """``(core, depth, root, problem)`` of cores ``(core, parent)``: the chain of parents, at most ``most`` long."""
    parents = cores.select(F.col("core").alias("_core"), F.col("parent").alias("_parent"))
    rows = cores.select("core", F.col("parent").alias("next"), F.array("core").alias("chain"), F.lit(None).cast("string").alias("problem"))
    for _ in range(most):
        step = rows.join(parents, rows["next"] == parents["_core"], "left")
        loop = F.array_contains("chain", F.col("next"))
        deep = F.size("chain") >= most
        problem = F.when(F.col("problem").isNotNull() | F.col("next").isNull(), F.col("problem")).when(loop, "cycle").when(deep, "too_deep")
        go = F.col("next").isNotNull() & problem.isNull()
        rows = step.select("core", F.when(go, F.col("_parent")).alias("next_"),
            F.when(go, F.array_append("chain", F.col("next"))).otherwise(F.col("chain")).alias("chain"),
                           problem.alias("problem")).withColumnRenamed("next_", "next")
    return rows.select("core", F.size("chain").alias("depth"), F.element_at("chain", -1).alias("root"), "problem")


def overlaid(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Settings ``(name, value)`` of a parent that a child's overrule, unless the child's is unspecified or empty."""
    own = child.where("value IS NOT NULL AND value NOT IN ('', 'unspecified')").select("name", F.col("value").alias("_value"))
    return parent.join(own, "name", "full_outer").select("name", F.coalesce("_value", "value").alias("value"))


def style_block(rules: DataFrame, cap: int) -> DataFrame:
    """``(core, text)`` of rules ``(core, rule, severity, text)``: all, or without may, or without should, the first that fits.

    Rules of a severity go by their names up to a number at the end, then by that number, however many digits it has.
    """
    number = F.ltrim(F.regexp_extract("rule", r"(\d+)$", 1), F.lit("0"))
    order = F.struct(F.array_position(F.array(F.lit("must"), F.lit("should"), F.lit("may")), F.col("severity")).alias("s"),
        F.regexp_replace("rule", r"\d+$", "").alias("name"), F.length(number).alias("digits"), number.alias("number"), "rule")
    line = F.concat(F.lit("- ["), F.col("rule"), F.lit("] "), F.trim(F.translate("text", "<>", "‹›")))
    rows = rules.groupBy("core").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))).alias("ls"))
    text = lambda top: F.array_join(F.transform(F.filter("ls", lambda x: x["o"]["s"] <= top), lambda x: x["l"]), "\n")
    fits = lambda t: F.when(F.length(t) <= cap, t)
    return rows.select("core", F.coalesce(fits(text(3)), fits(text(2)), text(1)).alias("text"))


def cited_sources(cites: DataFrame, evidence: DataFrame, paras: DataFrame) -> DataFrame:
    """Citations ``(block, unit)`` down to places: evidence ``(unit, doc_id, pid)`` to paragraphs ``(doc_id, pid, page, timecode)``."""
    return cites.join(evidence, "unit").join(paras, ["doc_id", "pid"]).select("block", "unit", "doc_id", "pid", "page", "timecode")


def cite_problems(cites: DataFrame, section_units: DataFrame) -> DataFrame:
    """``(section, unit, problem)``: citations ``(section, unit)`` beyond the section's units ``(section, unit, importance)``, and core units uncited."""
    key = ["section", "unit"]
    strange = cites.select(key).distinct().join(section_units.select(key), key, "left_anti").withColumn("problem", F.lit("not_in_section"))
    uncited = section_units.where("importance = 'core'").select(key).join(cites.select(key), key, "left_anti").withColumn("problem",
        F.lit("core_uncited"))
    return strange.unionByName(uncited)


def page(title: str, rows: DataFrame, kind: str = "md") -> DataFrame:
    """``(section, value)``: sections ``(section, text)`` as Markdown or html parts, one row each, for ``write.text``."""
    if kind == "md":
        return rows.select("section", F.concat(F.lit("## "), "section", F.lit("\n\n"), "text", F.lit("\n")).alias("value"))
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"),
        F.lit("&gt;"))
    body = F.replace(safe(F.col("text")), F.lit("\n\n"), F.lit("</p><p>"))
    return rows.select("section", F.concat(F.lit(f"<section title=\"{title}\"><h2>"), safe(F.col("section").cast("string")), F.lit("</h2><p>"), body,
        F.lit("</p></section>")).alias("value"))
