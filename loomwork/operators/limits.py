"""What a finished log of calls tells about limits: token levels, leases that ran out, streaks of failures, and the waits
of both scopes. No key is held by one task: logs are cut into slices of time, slices are summed up to a row each, and
what comes before a slice is carried into it.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.scale import small

#: Seconds of a slice; a slice of one key is what a task holds.
SLICE = 3600


def sliced(rows: DataFrame, at: str = "at", width: float = SLICE) -> DataFrame:
    return rows.withColumn("_slice", F.floor(F.col(at) / width))


def carried(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, name: str) -> DataFrame:
    """The rows, which have ``_slice``, with the running sum of a value per key up to and with each row.

    Sums run within a slice; what all slices before add up to is a small table that is joined.
    """
    own = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy(*keys, "_slice").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_slice").alias("_s"),
                           F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    same = rows["_slice"].eqNullSafe(totals["_s"])
    for i, k in enumerate(keys):
        same &= rows[k].eqNullSafe(totals[f"_k{i}"])
    run = rows.withColumn(name, F.sum(value).over(own)).join(totals, same).withColumn(name, F.col(name) + F.col("_before"))
    return run.select(*rows.columns, name)


def previous(rows: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], column: str, name: str, width: float = SLICE) -> DataFrame:
    """The rows with a column of the key's row before, which may lie in an earlier slice; no task holds a key."""
    rows = sliced(rows, at, width)
    last = rows.groupBy(*keys, "_slice").agg(F.max_by(F.struct(column), F.struct(at, *order)).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    last = last.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_slice").alias("_s"), before.alias("_before"))
    same = rows["_slice"].eqNullSafe(last["_s"])
    for i, k in enumerate(keys):
        same &= rows[k].eqNullSafe(last[f"_k{i}"])
    own = F.lag(F.struct(column)).over(Window.partitionBy(*keys, "_slice").orderBy(at, *order))
    both = rows.withColumn("_own", own).join(last, same)
    found = F.coalesce("_own", "_before")[column]
    return both.select(*(c for c in rows.columns if c != "_slice"), found.alias(name))


# Token buckets ------------------------------------------------------------------------------------------------------

#: A step of a bucket is x -> max(low, min(high, x + plus)); steps are closed under composition.
STEP = "plus double, low double, high double"


def _then(step: tuple, plus: float, low: float, high: float) -> tuple:
    """A step after another one."""
    p, lo, hi = step
    return p + plus, min(high, max(low, lo + plus)), min(high, max(low, hi + plus))


def _through(part: pd.DataFrame, width: float) -> tuple[list[tuple], tuple]:
    """The steps from the start of a slice up to each event, before and after it, and to the end of the slice."""
    cap = float(part["cap"].iloc[0])
    rate, now = cap / 60, float(part["_slice"].iloc[0]) * width
    end = now + width
    step, out = (0.0, -float("inf"), float("inf")), []
    for at, spent, back in zip(part["at"], part["spent"], part["back"], strict=True):
        step = _then(step, rate * (at - now), -float("inf"), cap)
        before = step
        step = _then(step, -float(spent), -float("inf"), float("inf")) if spent else step
        step = _then(step, float(back), 0.0, cap) if back else step
        out.append((before, step))
        now = at
    return out, _then(step, rate * (end - now), -float("inf"), cap)


def token_levels(events: DataFrame, caps: DataFrame, width: float = SLICE) -> DataFrame:
    """``(scope, seq, at, spent, back, before, after)``: the level of each scope's bucket around each of its events.

    ``events``: ``scope, seq, at, spent, back``, granted calls with what they take at their time, and settlements with what
    they give back (or charge, if negative, down to an empty bucket). ``caps``: ``scope, cap``, which refills in a minute. A
    bucket is full at first and refills continuously. Each slice is one composed step; a scope's slices, few and small, are
    put one after another, and then every slice is evaluated from the level that it starts with.
    """
    rows = sliced(events, width=width).join(small(caps), "scope").select("scope", "seq", "at", "spent", "back", "cap", "_slice")

    def composed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        whole = _through(part.sort_values(["at", "seq"]), width)[1]
        return pd.DataFrame([(*key, float(part["cap"].iloc[0]), *whole)], columns=["scope", "_slice", "cap", "plus", "low", "high"])

    def starts(key: tuple, slices: pd.DataFrame) -> pd.DataFrame:
        slices, out = slices.sort_values("_slice"), []
        level, last = float(slices["cap"].iloc[0]), None
        for s in slices.itertuples(index=False):
            number, cap, plus, low, high = s[1:]
            level = level if last is None else min(cap, level + cap / 60 * width * (number - last - 1))
            out.append((key[0], number, level))
            level, last = max(low, min(high, level + plus)), number
        return pd.DataFrame(out, columns=["scope", "_slice", "start"])

    def levels(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["at", "seq"])
        start = float(part["start"].iloc[0])
        at = [tuple(max(low, min(high, start + plus)) for plus, low, high in pair) for pair in _through(part, width)[0]]
        return part[["scope", "seq", "at", "spent", "back"]].assign(before=[a for a, _ in at], after=[b for _, b in at])

    kinds = dict(rows.dtypes)
    parts = rows.groupBy("scope", "_slice").applyInPandas(composed, f"scope {kinds['scope']}, _slice long, cap double, {STEP}")
    begun = parts.groupBy("scope").applyInPandas(starts, f"scope {kinds['scope']}, _slice long, start double")
    out = ", ".join(f"{c} {kinds[c]}" for c in ("scope", "seq", "at", "spent", "back"))
    return rows.join(begun, ["scope", "_slice"]).groupBy("scope", "_slice").applyInPandas(levels, f"{out}, before double, after double")


# Leases -------------------------------------------------------------------------------------------------------------


def settlements(leases: DataFrame, ends: DataFrame, ttl: float = 300.0) -> DataFrame:
    """Settlements ``(group, lease, at, seq, outcome)`` of leases ``(group, lease, at, ..)`` with ``accepted`` and ``reason``.

    The first one after the lease began and before it ran out counts; one that is repeated, too late or of no lease does nothing.
    """
    begun = leases.select(F.col("group").alias("_g"), F.col("lease").alias("_l"), F.col("at").alias("_at"))
    rows = ends.join(begun, ends["group"].eqNullSafe(begun["_g"]) & (ends["lease"] == begun["_l"]), "left")
    timely = F.coalesce((F.col("at") >= F.col("_at")) & (F.col("at") < F.col("_at") + ttl), F.lit(False))
    first = F.row_number().over(Window.partitionBy("group", "lease", "_timely").orderBy("at", "seq")) == 1
    rows = rows.withColumn("_timely", timely).withColumn("accepted", F.col("_timely") & first)
    reason = F.when(F.col("accepted"), F.col("outcome")).when(F.col("_at").isNull(), "unknown").when(F.col("_timely"), "repeated").otherwise("late")
    return rows.withColumn("reason", reason).select(*ends.columns, "accepted", "reason")


def lease_ends(leases: DataFrame, ends: DataFrame, ttl: float = 300.0) -> DataFrame:
    """The leases with ``ended_at`` and ``how``: ``settled`` with an outcome, or ``expired`` at the end of their time."""
    done = settlements(leases, ends, ttl).where("accepted").select(
        F.col("group").alias("_g"), F.col("lease").alias("_l"), F.col("at").alias("_end"), F.col("outcome").alias("outcome"))
    rows = leases.join(done, leases["group"].eqNullSafe(done["_g"]) & (leases["lease"] == done["_l"]), "left")
    return rows.select(*(leases[c] for c in leases.columns), F.coalesce("_end", F.col("at") + ttl).alias("ended_at"),
                       F.when(F.col("_end").isNull(), "expired").otherwise("settled").alias("how"), "outcome")


def in_flight(leases: DataFrame, width: float = SLICE) -> DataFrame:
    """``(group, lease, at, running)``: how many of the group's leases run when each begins, itself included; ends at that time come first."""
    starts = leases.select("group", "lease", "at", F.lit(1).alias("d"))
    both = starts.unionByName(leases.select("group", "lease", F.col("ended_at").alias("at"), F.lit(-1).alias("d")))
    run = carried(sliced(both, width=width), ["group"], ["at", "d", "lease"], F.col("d"), "running")
    return run.where("d = 1").select("group", "lease", "at", "running")


def credential_states(requests: DataFrame, credentials: DataFrame, ended: DataFrame) -> DataFrame:
    """Requests ``(group, seq, at)`` with ``active``, the group's credentials that work then, and ``reason``.

    ``credentials``: ``group, credential``. ``ended``: leases with their credential, ``ended_at`` and ``outcome``; an
    ``auth_error`` quarantines the credential from then on. The credentials of a group are one small row of times.
    """
    lost = ended.where("outcome = 'auth_error'").groupBy("group", "credential").agg(F.min("ended_at").alias("lost_at"))
    keys = credentials.join(lost, ["group", "credential"], "left").groupBy("group")
    keys = keys.agg(F.count("*").alias("_n"), F.collect_list("lost_at").alias("_lost")).withColumnRenamed("group", "_g")
    rows = requests.join(keys, requests["group"].eqNullSafe(F.col("_g")), "left")
    gone = F.size(F.filter(F.coalesce("_lost", F.array().cast("array<double>")), lambda t: t <= F.col("at")))
    active = (F.coalesce("_n", F.lit(0)) - gone).cast("long")
    return rows.withColumn("active", active).withColumn("reason", F.when(F.col("active") == 0, "no_credential")).select(*requests.columns, "active", "reason")


# Streaks ------------------------------------------------------------------------------------------------------------

FAILED = ("server_error", "timeout", "network_error")


def failure_streaks(calls: DataFrame, trip: int = 3, width: float = SLICE) -> DataFrame:
    """Failed calls ``(deployment, seq, at)`` with ``island``, ``streak`` and ``opens``, true for the failure that opens a circuit.

    A streak is the failures since the last call that went well; other outcomes neither count nor end it. ``island`` is the
    number of good calls before, carried over slices, and a streak's number is the running count of failures less what that
    count was at the last good call.
    """
    rows = calls.where((F.col("outcome") == "ok") | F.col("outcome").isin(*FAILED)).select("deployment", "seq", "at", (F.col("outcome") == "ok").cast("long").alias("ok"))
    rows = sliced(rows, width=width)
    rows = carried(rows, ["deployment"], ["at", "seq"], F.col("ok"), "island")
    rows = carried(rows, ["deployment"], ["at", "seq"], 1 - F.col("ok"), "_failed")
    first = rows.where("ok = 1").groupBy(F.col("deployment").alias("_d"), F.col("island").alias("_i")).agg(F.max("_failed").alias("_base"))
    bad = rows.where("ok = 0")
    bad = bad.join(first, bad["deployment"].eqNullSafe(first["_d"]) & (bad["island"] == first["_i"]), "left")
    streak = (F.col("_failed") - F.coalesce("_base", F.lit(0))).cast("long")
    return bad.select("deployment", "seq", "at", F.col("island").cast("long").alias("island"), streak.alias("streak"), (streak == trip).alias("opens"))


def streaks(failures: DataFrame) -> DataFrame:
    """``(deployment, island, length, first_at, last_at)`` of each streak."""
    return failures.groupBy("deployment", "island").agg(F.count("*").alias("length"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


# Both scopes at each decision ----------------------------------------------------------------------------------------


def as_of(events: DataFrame, states: DataFrame, key: str, columns: Sequence[str], width: float = SLICE) -> DataFrame:
    """The events with the columns of the key's latest state row at or before their time ``at``; null before the first.

    Events and states are put together and filled forward within slices of time; what is last known before a slice is
    filled over the few rows that slices make, so a key with most events is spread over its slices. Of states at one time
    the one with the greatest ``seq`` counts.
    """
    packed = F.struct(*columns)
    kind = states.select(packed.alias("s")).schema["s"].dataType
    known = states.select(F.col(key).alias("_k"), F.col("at").alias("_t"), F.lit(0).alias("_kind"), F.col("seq").alias("_seq"), packed.alias("_state"))
    wanted = events.select(F.col(key).alias("_k"), F.col("at").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_seq"),
                           F.lit(None).cast(kind).alias("_state"), F.struct(*events.columns).alias("_event"))
    rows = sliced(known.unionByName(wanted, allowMissingColumns=True), "_t", width)
    last = F.max_by("_state", F.when(F.col("_kind") == 0, F.struct("_t", "_seq")))
    slices = rows.groupBy("_k", "_slice").agg(last.alias("_last"))
    over = Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.select(F.col("_k").alias("_bk"), F.col("_slice").alias("_bs"), F.last("_last", ignorenulls=True).over(over).alias("_before"))
    run = Window.partitionBy("_k", "_slice").orderBy("_t", "_kind", "_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumn("_own", F.last("_state", ignorenulls=True).over(run)).where("_kind = 1")
    filled = filled.join(before, filled["_k"].eqNullSafe(before["_bk"]) & (filled["_slice"] == before["_bs"]))
    return filled.select("_event.*", *(F.coalesce(F.col("_own")[c], F.col("_before")[c]).alias(c) for c in columns))


def scope_waits(requests: DataFrame, groups: DataFrame, deployments: DataFrame, width: float = SLICE) -> DataFrame:
    """Requests ``(seq, group, deployment, at)`` with the wait and the reason that bind them.

    ``groups`` and ``deployments`` are states over time: ``group`` or ``deployment``, ``at, seq, cool`` (calls wait until then),
    ``running`` and ``most`` (calls at once). Both scopes are read as of the request. The longest wait binds; of equal ones
    the first in the order group's cool-down, deployment's, group's places, deployment's.
    """
    names = {"group": groups, "deployment": deployments}
    rows = requests
    for scope, states in names.items():
        states = states.select(F.col(scope), "at", "seq", F.col("cool").alias(f"{scope}_cool"), F.col("running").alias(f"{scope}_running"), F.col("most").alias(f"{scope}_most"))
        rows = as_of(rows, states, scope, [f"{scope}_cool", f"{scope}_running", f"{scope}_most"], width)
    cool = [F.when(F.col(f"{s}_cool") > F.col("at"), F.struct((F.col(f"{s}_cool") - F.col("at")).alias("wait"), F.lit(-i).alias("nth"), F.lit(f"{s}_cooldown").alias("reason")))
            for i, s in enumerate(names)]
    full = [F.when(F.col(f"{s}_running") >= F.col(f"{s}_most"), F.struct(F.lit(1.0).alias("wait"), F.lit(-2 - i).alias("nth"), F.lit(f"{s}_concurrency").alias("reason")))
            for i, s in enumerate(names)]
    rows = rows.withColumn("_worst", F.greatest(*cool, *full))
    return rows.select(*requests.columns, F.coalesce("_worst.wait", F.lit(0.0)).alias("wait"), F.coalesce("_worst.reason", F.lit("")).alias("reason"))
