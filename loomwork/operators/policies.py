"""Decisions of a document job: gates, limits, alerts, samples, refunds and reruns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import cell
from loomwork.operators.limits import carried
from loomwork.operators.scale import dense_numbers

# What a refund gives back of a charge, by event.
REFUND_SHARE = {"failed": 1.0, "canceled_early": 1.0, "canceled_late": 0.5, "grade_c": 0.5}


def glossary_gate(candidates: DataFrame, words: Column, least: float = 0.7, short: int = 2000) -> DataFrame:
    """Candidates with ``status`` when nobody answers in time: sure ones are confirmed; short documents skip the gate."""
    status = F.when(words < short, "skipped").when(F.col("confidence") >= least, "confirmed").otherwise("rejected")
    return candidates.withColumn("status", status)


def admitted_jobs(jobs: DataFrame, capacity: DataFrame) -> DataFrame:
    """Jobs ``(job_id, profile, at, calls)`` with ``admitted``: the day's calls of the profile so far fit its capacity ``(profile, calls_left)``.

    A profile's running sum goes by hours, so a profile with most jobs is spread over them.
    """
    rows = jobs.withColumn("_slice", F.date_trunc("hour", F.col("at").cast("timestamp")))
    rows = carried(rows, ["profile"], ["at", "job_id"], F.col("calls"), "needed").drop("_slice").join(capacity, "profile", "left")
    return rows.withColumn("admitted", F.col("needed") <= F.coalesce("calls_left", F.lit(0)))


def over_cost(costs: DataFrame, estimates: DataFrame, factor: float = 1.5) -> DataFrame:
    """``(job_id, cost_id)`` of the first cost with which a job exceeds ``factor`` times its estimate."""
    order = Window.partitionBy("job_id").orderBy("at", "cost_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = costs.withColumn("_spent", F.sum("cost").over(order)).join(estimates, "job_id").where(F.col("_spent") > F.col("estimate") * factor)
    return rows.groupBy("job_id").agg(F.min_by("cost_id", F.struct("at", "cost_id")).alias("cost_id"))


def daily_limit(jobs: DataFrame, limit: int) -> DataFrame:
    """Jobs ``(job_id, user_id, day, at)`` with ``allowed``: the first so many of a user's day."""
    nth = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("at", "job_id"))
    return jobs.withColumn("allowed", nth <= limit)


def alerts(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``(metric, value)`` of metrics above (``above``) or below their threshold."""
    rows = metrics.join(F.broadcast(thresholds), "metric")
    return rows.where(F.when(F.col("above"), F.col("value") > F.col("limit")).otherwise(F.col("value") < F.col("limit"))).select("metric", "value")


def refund_due(charges: DataFrame) -> DataFrame:
    """Charges ``(job_id, charged, event, progress)`` with ``refund``, whole credits; a job stopped by its cost cap gets back what it did not use."""
    share = F.lit(0.0)
    for event, part in REFUND_SHARE.items():
        share = F.when(F.col("event") == event, F.lit(part)).otherwise(share)
    share = F.when(F.col("event") == "job_cost_cap", 1 - F.col("progress")).otherwise(share)
    return charges.withColumn("refund", F.floor(F.col("charged") * share).cast("long"))


def hash_sample(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """A share of the rows, the same ones at every run."""
    return rows.where(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 100 < percent)


def reruns(segments: DataFrame, most: float = 0.3) -> DataFrame:
    """Work that follows from results ``(segment, first_idx, last_idx, bad_ratio, truncated, runs)``: once more with feedback, or in two halves if cut off."""
    middle = F.expr("(first_idx + last_idx) div 2").cast("int")
    whole = F.array(F.struct(F.lit("rerun").alias("action"), F.col("first_idx").alias("a"), F.col("last_idx").alias("b")))
    halves = F.array(F.struct(F.lit("half").alias("action"), F.col("first_idx").alias("a"), middle.alias("b")),
        F.struct(F.lit("half").alias("action"), (middle + 1).alias("a"), F.col("last_idx").alias("b")))
    todo = F.when(F.col("truncated") & (F.col("first_idx") < F.col("last_idx")), halves).when((F.col("bad_ratio") > most) & (F.col("runs") < 2),
        whole)
    return segments.select("segment", F.explode(todo).alias("t")).select("segment", "t.*")


def facts(units: DataFrame) -> DataFrame:
    """``(unit, statement, number)``: the numbers of units of facts, one row each."""
    return units.where("type = 'fact_data'").select("unit", "statement", F.explode("numbers").alias("number"))


def unit_stats(units: DataFrame, words: DataFrame) -> DataFrame:
    """``(doc_id, units, core, density, unverified_core, flagged)``: units per thousand words and the share of unverified core ones."""
    rows = units.groupBy("doc_id").agg(F.count("*").alias("units"), F.count_if(F.col("importance") == "core").alias("core"),
                                       F.count_if((F.col("importance") == "core") & ~F.col("verified")).alias("bad"))
    share = F.when(F.col("core") > 0, F.col("bad") / F.col("core")).otherwise(F.lit(0.0))
    rows = rows.join(words, "doc_id").withColumn("unverified_core", share)
    return rows.select("doc_id", "units", "core", (F.col("units") * 1000 / F.col("words")).alias("density"), "unverified_core",
        (F.col("unverified_core") >= 0.03).alias("flagged"))


def top_topics(units: DataFrame, n: int = 10) -> DataFrame:
    """``(topic, core)``: the topics with the most core units."""
    rows = units.where("importance = 'core'").select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("core"))
    return rows.orderBy(F.desc("core"), "topic").limit(n)


def profile_sample(text: Column, per_token: float = 4.0, whole: int = 15_000) -> Column:
    """Parts of a long text: 6,000 tokens of its head, three times 2,000 of its middle, 2,000 of its tail."""
    size = lambda n: int(n * per_token)
    at = lambda q: F.floor(F.length(text) * q).cast("int") - size(1000)
    parts = [F.substring(text, 1, size(6000)), *(F.substr(text, at(q), F.lit(size(2000))) for q in (0.4, 0.55, 0.7)),
        F.right(text, F.lit(size(2000)))]
    return F.when(F.length(text) < size(whole), F.array(text)).otherwise(F.array(*parts))


def segment_text(paras: DataFrame, *key: str) -> DataFrame:
    """``(key.., text)``: paragraphs as [pid] text, parted by blank lines."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.concat(F.lit("["), "pid", F.lit("] "), "text").alias("l")))), lambda x: x["l"])
    return paras.groupBy(*key).agg(F.array_join(lines, "\n\n").alias("text"))


def unit_lines(units: DataFrame) -> DataFrame:
    """``(unit, line)``: one line of cells per unit."""
    cells = [F.col("unit"), F.col("importance"), F.col("type"), cell(F.col("title")), cell(F.col("statement")), cell(F.array_join("topics", ", "))]
    return units.select("unit", F.concat_ws(" | ", *cells).alias("line"))


def stage_stats(units: DataFrame) -> DataFrame:
    """``(doc_id, by, importance, state, reason, n)``: units of each document by importance, by state, by both, and by reason of omission.

    One pass counts all groupings; of units without a reason the last one has none.
    """
    sets = [["doc_id", "importance"], ["doc_id", "state"], ["doc_id", "importance", "state"], ["doc_id", "reason"]]
    cols = ["doc_id", "importance", "state", "reason"]
    rows = units.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    by = F.when(F.col("_g") == 0b0011, "importance").when(F.col("_g") == 0b0101, "state").when(F.col("_g") == 0b0001, "importance,state").otherwise("reason")
    return rows.select("doc_id", by.alias("by"), "importance", "state", "reason", "n").where("by <> 'reason' OR reason IS NOT NULL")


def source_shares(paragraphs: DataFrame) -> DataFrame:
    """``(doc_id, label, paragraphs, words, share)``: how much of a document's words each label of paragraphs has."""
    rows = paragraphs.groupBy("doc_id", "label").agg(F.count("*").alias("paragraphs"), F.sum("words").cast("long").alias("words"))
    whole = F.sum("words").over(Window.partitionBy("doc_id"))
    return rows.withColumn("share", F.when(whole > 0, F.col("words") / whole).otherwise(F.lit(0.0)))


def inserted_once(existing: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows to append, those whose key is not there, and how many of the new ones that is: ``(inserted, skipped)``."""
    fresh = new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    counts = new.agg(F.count("*").alias("all")).crossJoin(fresh.agg(F.count("*").alias("inserted")))
    return fresh, counts.select("inserted", (F.col("all") - F.col("inserted")).alias("skipped"))


def merged_by_id(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The union of two lists by id; of two rows with an id the first list's stays."""
    return first.unionByName(second.join(first.select(key), key, "left_anti").dropDuplicates([key]))


def cloned(deployments: DataFrame, groups: DataFrame) -> DataFrame:
    """Deployments of a source group under new ids for each new group ``(group_id, source)``."""
    d = deployments.withColumnsRenamed({"group_id": "source", "deployment": "_from"})
    rows = groups.join(d, "source").drop("source")
    return rows.withColumn("deployment", F.concat_ws("-", "group_id", F.regexp_replace("_from", "^.*-", ""))).drop("_from")


def numbered_after(existing: DataFrame, new: DataFrame, stem: str, order: str) -> DataFrame:
    """New rows with ``id`` stem-n, counted on from the greatest number that exists."""
    last = existing.agg(F.coalesce(F.max(F.regexp_extract("id", rf"^{stem}-(\d+)$", 1).try_cast("int")), F.lit(0)).alias("_last"))
    rows = dense_numbers(new, [order], "_n").crossJoin(F.broadcast(last))  # one row
    return rows.withColumn("id", F.concat(F.lit(f"{stem}-"), F.col("_last") + F.col("_n"))).drop("_last", "_n")
