"""Credits and spending: balances, charges, refunds, invitations, effective-dated prices and daily caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.limits import carried
from loomwork.operators.scale import folded


def balances(ledger: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """``(user_id, balance)``; with a table of users those without entries have 0."""
    sums = ledger.groupBy("user_id").agg(F.sum("delta").alias("balance"))
    if users is None:
        return sums
    return users.select("user_id").join(sums, "user_id", "left").withColumn("balance", F.coalesce("balance", F.lit(0)))


def running_balance(ledger: DataFrame) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("at", "entry_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ledger.withColumn("balance", F.sum("delta").over(order))


def charges(requests: DataFrame, opening: DataFrame) -> DataFrame:
    """Requests ``(user_id, seq, amount, idem)`` with ``accepted`` and the ``balance`` after them.

    A charge stands if the balance left by earlier ones covers it; a repeated key changes nothing and is accepted. What
    is accepted depends on all before, so a user's requests are run through in order, with the balance as the only state.
    """
    first = Window.partitionBy("user_id", "idem").orderBy("seq")
    rows = requests.withColumn("again", F.col("idem").isNotNull() & (F.row_number().over(first) > 1))
    rows = rows.join(opening, "user_id", "left").select(
        "user_id", "seq", F.coalesce(F.col("amount").cast("long"), F.lit(0)).alias("amount"), "again",
        F.coalesce(F.col("balance").cast("long"), F.lit(0)).alias("open"))

    def charge(left: int, r: tuple) -> tuple[int, tuple]:
        stands = not r.again and 0 < r.amount <= left
        left -= r.amount if stands else 0
        return left, (r.user_id, r.seq, r.amount, bool(r.again or stands), left)

    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("user_id", "seq"))
    return folded(rows, "user_id", ["seq"], lambda r: r.open, charge, f"{kind}, amount bigint, accepted boolean, balance bigint")


def refunds(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Requests ``(job_id, amount)`` with ``refund``: never more than was charged and not yet given back."""
    open_ = ledger.where(F.col("reason").isin("job_charge", "job_refund")).groupBy("job_id").agg((-F.sum("delta")).alias("refundable"))
    refund = F.greatest(F.lit(0), F.least(F.col("amount"), F.coalesce("refundable", F.lit(0))))
    return requests.join(open_, "job_id", "left").withColumn("refund", refund)


def redeemed(attempts: DataFrame, codes: DataFrame) -> DataFrame:
    """Attempts ``(attempt_id, code, user_id, at)`` with ``status`` ok, invalid, repeated or exhausted against ``(code, max_uses, credits, expires_at, revoked)``."""
    rows = attempts.withColumn("code", F.upper("code")).join(codes, "code", "left")
    valid = F.col("max_uses").isNotNull() & ~F.coalesce("revoked",
        F.lit(False)) & (F.col("expires_at").isNull() | (F.col("expires_at") >= F.col("at")))
    rows = rows.withColumn("_valid", valid)
    once = Window.partitionBy("code", "user_id", "_valid").orderBy("at", "attempt_id")
    rows = rows.withColumn("_first", F.col("_valid") & (F.row_number().over(once) == 1))
    rank = F.row_number().over(Window.partitionBy("code", "_first").orderBy("at", "attempt_id"))
    rows = rows.withColumn("_rank", rank)
    status = F.when(~F.col("_valid"), "invalid").when(~F.col("_first"), "repeated").when(F.col("_rank") > F.col("max_uses"),
        "exhausted").otherwise("ok")
    return rows.withColumn("status", status).drop("_valid", "_first", "_rank")


def priced(calls: DataFrame, prices: DataFrame, strict: bool = True) -> DataFrame:
    """Calls ``(model, day, ..)`` with the latest price of ``(model, effective_from, ..)`` not after the day.

    Prices become intervals up to the next one, so each call meets one row; the small table of intervals is for the
    optimizer to broadcast. A call without a price fails the query if ``strict``.
    """
    until = F.lead("effective_from").over(Window.partitionBy("model").orderBy("effective_from"))
    spans = prices.withColumn("_until", until).withColumnRenamed("model", "_model")
    on = (calls["model"] == spans["_model"]) & (calls["day"] >= spans["effective_from"]) & (spans["_until"].isNull() | (calls["day"] < spans["_until"]))
    rows = calls.join(spans, on, "left").drop("_model", "_until")
    if not strict:
        return rows
    known = F.when(F.col("effective_from").isNull(), F.raise_error(F.concat(F.lit("no_price_for_model "),
        F.coalesce("model", F.lit("?"))))).otherwise(F.col("effective_from"))
    return rows.withColumn("effective_from", known)


def cost_usd() -> Column:
    """Cost of a priced call with ``tokens_in`` (cached ones included), ``tokens_cached, tokens_out, tokens_think, batch``."""
    fresh = F.greatest(F.col("tokens_in") - F.col("tokens_cached"), F.lit(0))
    cached = F.col("tokens_cached") * F.coalesce("cached_input_per_mtok", "input_per_mtok")
    total = fresh * F.col("input_per_mtok") + cached + (F.col("tokens_out") + F.col("tokens_think")) * F.col("output_per_mtok")
    return F.round(total / 1_000_000 * F.when(F.col("batch"), F.col("batch_multiplier")).otherwise(F.lit(1)), 6)


def daily_spend(costs: DataFrame, cap: float) -> DataFrame:
    """Costs ``(day, at, cost_id, cost)`` with the day's running ``spent`` and whether the cap has ``paused`` it; a day is summed by minutes."""
    rows = costs.withColumn("_slice", F.date_trunc("minute", F.col("at").cast("timestamp")))
    rows = carried(rows, ["day"], ["at", "cost_id"], F.col("cost"), "spent").drop("_slice")
    return rows.withColumn("paused", F.col("spent") >= cap)


def upsert_spend(old: DataFrame, new: DataFrame) -> DataFrame:
    """Totals ``(day, cost)`` with new costs added."""
    return old.select("day", "cost").unionByName(new.select("day", "cost")).groupBy("day").agg(F.sum("cost").alias("cost"))


def abuse(spend: DataFrame, factor: float = 5.0) -> DataFrame:
    """``(user_id, at, spent_24h)`` where a user's last 24 hours exceed ``factor`` times the mean of all such sums."""
    day = Window.partitionBy("user_id").orderBy(F.unix_seconds("at")).rangeBetween(-86_400, 0)
    rows = spend.select("user_id", "at", F.sum("cost").over(day).alias("spent_24h"))
    mean = rows.agg(F.avg("spent_24h").alias("mean_24h"))
    return rows.join(F.broadcast(mean)).where(F.col("spent_24h") > F.col("mean_24h") * factor).drop("mean_24h")
