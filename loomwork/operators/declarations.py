"""Key declarations compiled as one table: the first claim of a key wins, groups are numbered on, flags and gates are derived.

Declarations have an order, and each sees what those before it added. That is not a loop: a key's first claim is its least
(declaration, position), groups are numbered by their first key, and the groups that a provider and tier have by then are a
running count over new groups, which are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Flags that need the owner's consent, and those that keep a group from public gates.
RISKS, NOT_PUBLIC = ("multi_account_risk", "trial_only"), ("multi_account_risk", "trial_only")
ALL_GATES = ("dev", "A", "B", "C")
TRIAL = ("trial_only", "no_personal_data")


def _texts(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def judged(keys: DataFrame, known: DataFrame) -> DataFrame:
    """Keys ``(declaration, pos, fingerprint, status, ..)`` with the status of repeated ones.

    A good key whose fingerprint is ``known`` is ``duplicate_existing``; one that its own declaration has earlier is
    ``duplicate_in_request``; one that another declaration claimed first is ``duplicate_across``, an error.
    """
    ok = F.col("status") == "ok"
    first = keys.where(ok).groupBy(F.col("fingerprint").alias("_f")).agg(F.min(F.struct("declaration", "pos")).alias("_first"))
    own = keys.where(ok).groupBy(F.col("fingerprint").alias("_g"), F.col("declaration").alias("_d")).agg(F.min("pos").alias("_own"))
    rows = keys.join(first, F.col("fingerprint") == F.col("_f"), "left")
    rows = rows.join(own, (F.col("fingerprint") == F.col("_g")) & (F.col("declaration") == F.col("_d")), "left")
    rows = rows.join(known.select(F.col("fingerprint").alias("_k")).where("_k IS NOT NULL").distinct(), F.col("fingerprint") == F.col("_k"), "left")
    status = (F.when(~ok, F.col("status")).when(F.col("_k").isNotNull(), "duplicate_existing").when(F.col("pos") > F.col("_own"), "duplicate_in_request")
              .when(F.col("declaration") > F.col("_first.declaration"), "duplicate_across").otherwise("ok"))
    return rows.select(*(c for c in keys.columns if c != "status"), status.alias("status"))


def planned(keys: DataFrame, declarations: DataFrame, groups: DataFrame) -> DataFrame:
    """``(declaration, pos, group_id)`` of the good keys.

    ``declarations``: ``declaration, provider, tier, mode``. One group takes all keys of a declaration in mode
    ``single_group``; else a key with a label goes to the group of that name and one without to the next number.
    """
    stem = F.concat_ws("-", "provider", F.replace("tier", F.lit("_"), F.lit("-")))
    rows = keys.where("status = 'ok'").join(declarations, "declaration").withColumn("_stem", stem)
    last = groups.select(F.regexp_extract("group_id", r"^(.*)-(\d+)$", 1).alias("_stem"), F.regexp_extract("group_id", r"-(\d+)$", 1).try_cast("int").alias("n"))
    last = last.where("n IS NOT NULL").groupBy("_stem").agg(F.max("n").alias("_last"))
    loose = (F.col("mode") != "single_group") & F.col("label").isNull()
    nth = F.row_number().over(Window.partitionBy("_stem", loose).orderBy("declaration", "pos"))
    rows = rows.join(last, "_stem", "left").withColumn("_n", F.coalesce("_last", F.lit(0)) + nth)
    name = F.when(F.col("mode") == "single_group", F.col("_stem")).otherwise(F.concat_ws("-", "_stem", F.coalesce("label", F.col("_n").cast("string"))))
    return rows.select("declaration", "pos", name.alias("group_id"))


def derived(plan: DataFrame, declarations: DataFrame, groups: DataFrame) -> DataFrame:
    """``(declaration, group_id, new, tos_flags, allowed_gates, problem)`` of each declaration's groups.

    ``declarations`` also has ``tos_flags, risk_ack``; ``groups`` are those there before: ``group_id, provider, tier, tos_flags,
    risk_ack``. Trial keys are for trials only and see no personal data; a second free or trial group of a provider is a risk of
    its terms. A risk that nobody has accepted is a problem. Groups with such flags stay off public gates.
    """
    before = groups.select("group_id", F.col("provider").alias("_p"), F.col("tier").alias("_t"), F.col("tos_flags").alias("_old"), F.col("risk_ack").alias("_acked"))
    rows = plan.select("declaration", "group_id").distinct().join(declarations, "declaration").join(before.drop("_p", "_t"), "group_id", "left")
    first = Window.partitionBy("group_id").orderBy("declaration")
    rows = rows.withColumn("new", F.col("_old").isNull() & (F.row_number().over(first) == 1))
    had = before.groupBy("_p", "_t").agg(F.count("*").alias("_had"))
    rows = rows.join(had, (F.col("provider") == F.col("_p")) & (F.col("tier") == F.col("_t")), "left")
    so_far = Window.partitionBy("provider", "tier").orderBy("declaration").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    have = F.coalesce("_had", F.lit(0)) + F.sum(F.col("new").cast("int")).over(so_far)
    none = _texts()
    flags = F.array_union(F.coalesce("tos_flags", none), F.coalesce("_old", none))
    flags = F.array_union(flags, F.when(F.col("tier") == "trial", _texts(*TRIAL)).otherwise(none))
    flags = F.array_union(flags, F.when(F.col("tier").isin("free", "trial") & (have >= 2), _texts("multi_account_risk")).otherwise(none))
    rows = rows.withColumn("_flags", F.array_sort(flags))
    gates = (F.when(F.array_contains("_flags", "trial_only"), _texts("dev")).when(F.arrays_overlap("_flags", _texts(*NOT_PUBLIC)), _texts("dev", "A"))
             .otherwise(_texts(*ALL_GATES)))
    open_risks = F.array_except(F.array_intersect("_flags", _texts(*RISKS)), F.array_union(F.coalesce("risk_ack", none), F.coalesce("_acked", none)))
    problem = F.when(F.size(open_risks) > 0, F.concat(F.lit("risk_not_accepted "), F.array_join(open_risks, ",")))
    return rows.select("declaration", "group_id", "new", F.col("_flags").alias("tos_flags"), gates.alias("allowed_gates"), problem.alias("problem"))


def preview(keys: DataFrame, plan: DataFrame, groups: DataFrame) -> DataFrame:
    """``(declaration, groups, new_groups, keys, skipped_keys, errors)`` of judged keys, their plan and the derived groups."""
    k = keys.groupBy("declaration").agg(F.count_if(F.col("status") == "ok").alias("keys"), F.count_if(F.col("status") != "ok").alias("skipped_keys"),
                                        F.count_if(F.col("status") == "duplicate_across").alias("_across"))
    g = groups.groupBy("declaration").agg(F.count("*").alias("groups"), F.count_if("new").alias("new_groups"), F.count("problem").alias("_open"))
    rows = k.join(g, "declaration", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("declaration", number("groups"), number("new_groups"), "keys", "skipped_keys",
                       (F.col("_across") + F.coalesce("_open", F.lit(0)) + F.when(F.col("keys") == 0, 1).otherwise(0)).cast("long").alias("errors"))
