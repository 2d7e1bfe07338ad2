"""Which deployment may serve a request, and how much a deployment can serve."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.scale import small

# Fixed values of the routing rules.
STRUCTURED = ["none", "json_object", "json_schema"]
RISK_FLAGS = ["multi_account_risk", "trial_only"]
PRIVATE_BLOCKING = ["trial_only", "no_personal_data"]
PUBLIC_GATES = ["B", "C"]
SPARE_TOKENS = 256


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def rank(level: Column) -> Column:
    return F.array_position(strings(STRUCTURED), level)


def tokens(estimate: Column, factor: Column) -> Column:
    return F.ceil(estimate * factor).cast("long")


def eligible(allow_public_risk: bool = False) -> Column:
    """The condition over a request ``r`` and a deployment ``d`` with its group and model."""
    d, r = (lambda c: F.col(f"d.{c}")), (lambda c: F.col(f"r.{c}"))
    tin, tout = tokens(r("est_in"), d("tokenizer_factor")), tokens(r("est_out"), d("tokenizer_factor"))
    risky = F.size(F.array_except(F.array_intersect(d("tos_flags"), strings(RISK_FLAGS)), d("risk_ack"))) > 0
    floor = F.forall(F.map_entries(r("min_quality")), lambda e: F.coalesce(F.element_at(d("quality"), e["key"]), F.lit(0.0)) >= e["value"])
    public = r("gate").isin(*PUBLIC_GATES) & F.arrays_overlap(d("tos_flags"), strings(RISK_FLAGS)) & F.lit(not allow_public_risk)
    safe = (d("data_policy") == "no_training") & ~F.arrays_overlap(d("tos_flags"), strings(PRIVATE_BLOCKING))
    return reduce(and_, [
        d("enabled"), ~F.array_contains(r("exclude"), d("deployment")), d("active_credentials") > 0,
        rank(d("structured")) >= rank(r("structured")), ~risky, ~r("needs_vision") | d("vision"), ~r("needs_pdf") | d("pdf"), floor,
        F.array_contains(d("allowed_gates"), r("gate")), ~public, (r("privacy") != "private") | safe,
        ~(r("region_restricted") & F.array_contains(d("tos_flags"), F.lit("no_eea_uk_ch"))), (d("price_mode") != "metered") | r("allow_metered"),
        tin + tout + SPARE_TOKENS <= d("ctx_in"), d("ctx_in") >= r("min_ctx_in"), tout <= d("max_out"),
        ~F.array_contains(r("avoid_groups"), d("group_id")),
        (F.size(r("select_tags")) == 0) | (F.size(F.array_except(r("select_tags"), d("tags"))) == 0),
        (F.size(r("select_tiers")) == 0) | F.array_contains(r("select_tiers"), d("tier"))])


def candidates(requests: DataFrame, deployments: DataFrame, allow_public_risk: bool = False) -> DataFrame:
    """``(request, deployment)`` pairs that may be served; the catalogue of deployments is a configuration, broadcast if a count finds it small."""
    return requests.alias("r").join(small(deployments).alias("d"), eligible(allow_public_risk)).select("r.request", "d.deployment", "d.weight")


def ordered(found: DataFrame, score: str = "weight") -> DataFrame:
    """Candidates in the order of their score, ties by name."""
    order = Window.partitionBy("request").orderBy(F.desc(score), "deployment")
    return found.withColumn("place", F.row_number().over(order))


def draw(*keys: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the seed and the keys."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(k.cast("string") for k in keys))), 1, 13), 16, 10).cast("long")
    return (bits + 0.5) / F.lit(2.0**52)


def shuffled(found: DataFrame, score: str = "score", seed: str = "pool-1") -> DataFrame:
    """Candidates with ``place`` in a weighted random order: each next one with the chance of its share of the scores left.

    The order is that of -ln(u) / score with a hash of seed, request and deployment for u, so reruns agree and no request is
    walked one candidate after another. A request's candidates are at most the catalogue.
    """
    key = -F.log(draw(F.col("request"), F.col("deployment"), seed=seed)) / F.greatest(F.col(score), F.lit(1e-9))
    order = Window.partitionBy("request").orderBy(key, "deployment")
    return found.withColumn("place", F.row_number().over(order))


def two_choices(found: DataFrame, score: str = "score", seed: str = "pool-1") -> DataFrame:
    """Candidates with ``place`` by score, where the best two change places with the chance of the second one's share of both."""
    best = ordered(found, score)
    pair = Window.partitionBy("request")
    first, second = (F.greatest(F.max(F.when(F.col("place") == i, F.col(score))).over(pair), F.lit(1e-9)) for i in (1, 2))
    three = F.count("*").over(pair) > 2  # two candidates keep their order
    swap = three & (draw(F.col("request"), seed=seed) * (first + second) > first)
    return best.withColumn("place", F.when(swap & (F.col("place") <= 2), 3 - F.col("place")).otherwise(F.col("place")))


def daily_capacity(limits: DataFrame) -> DataFrame:
    """``(deployment, calls, tokens)`` a day at most by limits ``rpm, tpm, rpd, tpd`` of the deployment (d) and its group (g)."""
    calls = [F.floor(F.col(f"{s}_rpd") * F.col("day_margin")) for s in "dg"]
    calls += [F.when(F.col(f"{s}_rpm").isNotNull(), F.floor(F.greatest(F.lit(1.0), F.col(f"{s}_rpm") * F.col("safety_margin")) * 1440)) for s in "dg"]
    toks = [F.floor(F.col(f"{s}_tpd") * F.col("day_margin")) for s in "dg"] + [F.floor(F.col(f"{s}_tpm") * F.col("safety_margin") * 1440) for s in "dg"]
    return limits.select("deployment", F.least(*calls).cast("long").alias("calls"), F.least(*toks).cast("long").alias("tokens"))


def headroom(states: DataFrame) -> DataFrame:
    """``(deployment, headroom)``: the least share left of any limit, of the ratios ``(deployment, ratio)``; null is no limit."""
    return states.groupBy("deployment").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min("ratio"))).alias("headroom"))


def score(free: Column, success: Column, weight: Column) -> Column:
    return free * (success * 0.5 + 0.5) * weight


def least_recent(credentials: DataFrame) -> DataFrame:
    """Each group's active credential that was used longest ago, never used ones first."""
    order = Window.partitionBy("group_id").orderBy(F.asc_nulls_first("last_used_at"), "credential")
    return credentials.where("status = 'active'").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def privacy_breaches(jobs: DataFrame, calls: DataFrame, groups: DataFrame) -> DataFrame:
    """Calls of private jobs to groups that do not refrain from training; there must be none."""
    unsafe = groups.where(~F.col("data_policy").eqNullSafe(F.lit("no_training"))).select("group_id")
    return calls.join(jobs.where("privacy = 'private'").select("job_id"), "job_id", "left_semi").join(unsafe, "group_id", "left_semi")


def smoothed(outcomes: DataFrame, key: str, value: str, order: str, keep: float = 0.9, start: float = 1.0) -> DataFrame:
    """``(key, ewma, n)``: the exponentially weighted mean of a key's values in their order."""
    # The mean is a sum of the values weighted by how many came after, so no list of a key's values is built.
    later = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) - 1
    rows = outcomes.select(key, F.col(value).cast("double").alias("v"), F.pow(F.lit(keep), later).alias("w"))
    ewma = F.sum(F.col("v") * F.col("w")) * (1 - keep) + F.pow(F.lit(keep), F.count("*")) * start
    return rows.groupBy(key).agg(ewma.alias("ewma"), F.count("*").cast("int").alias("n"))


def provider_risks(groups: DataFrame) -> DataFrame:
    """Groups ``(group_id, provider, tier)`` with how many of a provider's groups share the tier, and whether that is a risk."""
    same = groups.groupBy("provider", "tier").agg(F.count("*").alias("same"))
    risky = F.col("tier").isin("free", "trial") & (F.col("same") >= 2)
    return groups.join(same, ["provider", "tier"]).withColumn("multi_account_risk", risky)


def declared_groups(keys: DataFrame, existing: DataFrame) -> DataFrame:
    """Good keys ``(declaration, provider, grouping, label, pos)`` with the ``group_id`` they get, counted on from ``(group_id)``.

    ``grouping`` is per_key, by_label or single_group; a provider's new groups are numbered in the order of their first key.
    """
    unit = F.when(F.col("grouping") == "per_key", F.concat(F.lit("k"), F.col("pos"))).when(F.col("grouping") == "by_label",
        F.concat(F.lit("l"), F.coalesce("label", F.lit("")))).otherwise("all")
    rows = keys.withColumn("_unit", unit)
    new = rows.groupBy("provider", "declaration", "_unit").agg(F.min("pos").alias("_first"))
    last = existing.select(F.regexp_extract("group_id", r"^(.*)-(\d+)$", 1).alias("provider"),
        F.regexp_extract("group_id", r"-(\d+)$", 1).try_cast("int").alias("n"))
    new = new.join(last.groupBy("provider").agg(F.max("n").alias("_last")), "provider", "left")
    n = F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy("provider").orderBy("declaration", "_first"))
    new = new.select("provider", "declaration", "_unit", F.concat_ws("-", "provider", n).alias("group_id"))
    return rows.join(new, ["provider", "declaration", "_unit"]).drop("_unit")


def probe_scores(runs: DataFrame) -> DataFrame:
    """``(deployment, kind, score, p50)`` of probe calls ``(deployment, kind, valid, latency)``: share of valid replies and median latency."""
    return runs.groupBy("deployment", "kind").agg(F.avg(F.col("valid").cast("int")).alias("score"), F.median("latency").alias("p50"))
