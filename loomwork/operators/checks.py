"""Constraints and reference checks as tables of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``(key, rule)`` of the rules that rows break; a rule that is unknown (null) is not broken, as in SQL."""
    broken = F.filter(F.array(*(F.when(~cond, F.lit(name)) for name, cond in rules.items())), lambda x: x.isNotNull())
    return rows.select(key, F.explode(broken).alias("rule"))


def enforced(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows as they are; a broken rule fails the query."""
    for name, cond in rules.items():
        first = rows.columns[0]
        rows = rows.withColumn(first, F.when(F.coalesce(cond, F.lit(True)), F.col(first)).otherwise(F.raise_error(F.lit(f"check_violation {name}"))))
    return rows


def subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def duplicates(rows: DataFrame, *key: Column) -> DataFrame:
    """Keys that several rows have; rows with a null in the key do not count, as in a partial unique index."""
    named = [k.alias(f"key_{i}") for i, k in enumerate(key)]
    rows = rows.select(*named)
    for i in range(len(key)):
        rows = rows.where(F.col(f"key_{i}").isNotNull())
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).where("n > 1")


def drift(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """``(value, side)`` of values that only one of two declarations has."""
    a, b = left.select(value).distinct(), right.select(value).distinct()
    return a.join(b, value, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, value, "left_anti").withColumn("side",
        F.lit("right")))


def frozen(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``(key, problem)``: approved rows that were deleted, changed in content or moved to a status other than deprecated."""
    n = new.select(F.col(key).alias("_key"), F.col("content").alias("_content"), F.col("status").alias("_status"))
    rows = old.where("status = 'approved'").join(n, F.col(key) == F.col("_key"), "left")
    problem = (F.when(F.col("_key").isNull(), "deleted").when(~F.col("content").eqNullSafe(F.col("_content")), "content_changed")
               .when(~F.col("_status").isin("approved", "deprecated"), "bad_status"))
    return rows.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def pairing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(key, problem)`` unless each key is on both sides exactly once: missing, unknown or repeated."""
    a, b = (x.groupBy(key).agg(F.count("*").alias(n)) for x, n in ((left, "a"), (right, "b")))
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unknown").when(F.col("b") > 1, "repeated")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem IS NOT NULL")


def translation_problems(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """``(key, problem)`` of translated paragraphs: not paired one to one, empty, or of an odd length."""
    both = source.select(key, F.length("text").alias("n")).join(target.select(key, F.length(F.trim("text")).alias("m")), key)
    ratio = F.col("m") / F.col("n")
    problem = F.when(F.col("m") == 0, "empty").when((F.col("n") >= 40) & ~ratio.between(0.6, 2.2), "length_ratio")
    return pairing(source, target, key).unionByName(both.select(key, problem.alias("problem")).where("problem IS NOT NULL"))


def json_problems(rows: DataFrame, key: str, text: str, schema: str, required: list[str], rules: dict[str, Column]) -> DataFrame:
    """``(key, problem)`` of JSON texts against a schema: unreadable or of wrong types, missing fields, broken rules over ``j``."""
    parsed = rows.select(key, F.col(text).alias("_t"), F.from_json(text, f"{schema}, _bad string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j"))
    bad = F.col("_t").isNull() | F.col("j").isNull() | F.col("j._bad").isNotNull()
    found = [F.when(F.col(f"j.{c}").isNull(), F.lit(f"missing_{c}")) for c in required] + [F.when(~cond, F.lit(name)) for name, cond in rules.items()]
    found = F.when(bad, F.array(F.lit("unreadable"))).otherwise(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return parsed.select(key, F.explode(found).alias("problem"))
