"""Work queues as snapshots: claiming, reclaiming and deferring tasks, stages and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.limits import previous

SCAN = 500
# Share of each stage in a job's progress.
SYNTHESIS_WEIGHTS = {"extract": 5, "profile": 2, "segment": 1, "glossary": 6, "map": 30, "consolidate": 8, "write": 25, "verify": 15, "repair": 5,
    "assemble": 3}
TRANSLATION_WEIGHTS = {"extract": 5, "profile": 2, "segment": 1, "glossary": 7, "translate": 80, "assemble": 5}


def claimable(tasks: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Due pending tasks of running jobs that are not cancelled."""
    running = jobs.where("status = 'running' AND NOT cancel_requested").select("job_id")
    return tasks.where((F.col("status") == "pending") & (F.col("run_after") <= now)).join(running, "job_id", "left_semi")


def claimed(tasks: DataFrame, jobs: DataFrame, now: Column, limit: int, per_job: int) -> DataFrame:
    """The tasks that a worker gets: the oldest ``SCAN`` are looked at, at most ``per_job`` run per job, ``limit`` in all.

    Skipping a task only removes later ones of its job, so the loop is three ranks in the order of the queue. The scan
    is a top-k, after which at most ``SCAN`` rows are ranked.
    """
    order = ["created_at", "task_id"]
    head = claimable(tasks, jobs, now).orderBy(*order).limit(SCAN)
    busy = tasks.where("status = 'running'").groupBy("job_id").agg(F.count("*").alias("busy"))
    rows = head.join(busy, "job_id", "left")
    own = F.row_number().over(Window.partitionBy("job_id").orderBy(*order))
    rows = rows.withColumn("_own", own).where(F.col("_own") <= per_job - F.coalesce("busy", F.lit(0)))
    return rows.drop("_own", "busy").orderBy(*order).limit(limit)


def reclaimed(tasks: DataFrame, now: Column, stale: str = "3 minutes") -> DataFrame:
    """Tasks whose worker has gone silent back in the queue, or failed after their last attempt."""
    lost = (F.col("status") == "running") & (F.col("heartbeat_at") < now - F.expr(f"INTERVAL {stale}"))
    last = F.col("attempt") >= F.col("max_attempts")
    return tasks.withColumns({
        "status": F.when(lost & last, "failed").when(lost, "pending").otherwise(F.col("status")),
        "error_code": F.when(lost, "lease_expired").otherwise(F.col("error_code")),
        "locked_by": F.when(lost, F.lit(None)).otherwise(F.col("locked_by")),
        "finished_at": F.when(lost & last, now).otherwise(F.col("finished_at")),
    })


def deferred(tasks: DataFrame, until: DataFrame) -> DataFrame:
    """Running tasks of ``(task_id, until)`` put off without counting the attempt."""
    rows = tasks.join(until.select("task_id", "until"), "task_id", "left")
    off = F.col("until").isNotNull() & (F.col("status") == "running")
    return rows.withColumns({
        "status": F.when(off, "pending").otherwise(F.col("status")), "run_after": F.when(off, F.col("until")).otherwise(F.col("run_after")),
        "attempt": F.when(off, F.greatest(F.col("attempt") - 1, F.lit(0))).otherwise(F.col("attempt")),
        "locked_by": F.when(off, F.lit(None)).otherwise(F.col("locked_by"))}).drop("until")


def progress(stages: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """``(job_id, pct)`` from stages ``(job_id, stage, done, total)``."""
    weights = weights or SYNTHESIS_WEIGHTS
    weight = F.lit(0)
    for stage, value in weights.items():
        weight = F.when(F.col("stage") == stage, F.lit(value)).otherwise(weight)
    part = F.when(F.col("total") > 0, weight * F.col("done") / F.col("total")).otherwise(F.lit(0.0))
    return stages.groupBy("job_id").agg(F.round(F.sum(part), 2).alias("pct"))


#: The states that a job may go to from each; null is before its first.
MOVES = {None: ("queued",), "queued": ("running", "failed", "canceled"), "running": ("awaiting_glossary", "succeeded", "failed", "canceled"),
         "awaiting_glossary": ("running", "failed", "canceled"), "succeeded": ("expired",), "failed": ("expired",), "canceled": ("expired",), "expired": ()}


def job_moves(log: DataFrame, width: float = 86_400) -> DataFrame:
    """States ``(job_id, seq, at, status)`` with the one before, ``was``, and ``legal``: whether a job may go from there to here."""
    rows = previous(log, ["job_id"], "at", ["seq"], "status", "was", width)
    legal = F.lit(False)
    for was, then in MOVES.items():
        legal |= F.col("was").eqNullSafe(F.lit(was)) & F.col("status").isin(*then) if then else F.lit(False)
    return rows.withColumn("legal", F.coalesce(legal, F.lit(False)))


def next_stages(stages: DataFrame) -> DataFrame:
    """``(job_id, stage)`` to begin next: the first pending stage of a job, in the order of ``n``, whose stages before have all
    ``succeeded`` or been ``skipped``."""
    done = F.col("status").isin("succeeded", "skipped")
    first = stages.groupBy("job_id").agg(F.min(F.when(~done, F.struct("n", "stage", "status"))).alias("_open"))
    return first.where("_open.status = 'pending'").select("job_id", F.col("_open.stage").alias("stage"))


def ready_to_advance(stages: DataFrame) -> DataFrame:
    """Jobs and stages all of whose tasks are done."""
    return stages.groupBy("job_id", "stage").agg(F.bool_and(F.col("done") >= F.col("total")).alias("ready")).where("ready").drop("ready")


def first_requests(requests: DataFrame) -> DataFrame:
    """Requests without repeats of a user's idempotency key; a null key never repeats."""
    first = F.row_number().over(Window.partitionBy("user_id", "idem").orderBy("at", "request_id"))
    return requests.withColumn("_n", first).where("_n = 1 OR idem IS NULL").drop("_n")


def purged(documents: DataFrame, paragraphs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Documents with the expired ones marked deleted, and the paragraphs of the others."""
    over = F.col("expires_at").isNotNull() & (F.col("expires_at") < now) & (F.col("status") != "deleted")
    gone = documents.where(over).select("doc_id")
    marked = documents.withColumn("status", F.when(over, "deleted").otherwise(F.col("status")))
    return marked, paragraphs.join(gone, "doc_id", "left_anti")


def after_event(events: DataFrame, last_id: int, limit: int | None = None) -> DataFrame:
    """Events after a client's last one, in order: replay, and keyset pages with a limit."""
    rows = events.where(F.col("event_id") > last_id).orderBy("event_id")
    return rows.limit(limit) if limit else rows


#: Tables that a backup leaves out: what users delete must not live on in it.
NOT_BACKED_UP = {"doc_paragraphs", "doc_sections", "job_events"}


def back_up(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Write every table but those of ``NOT_BACKED_UP`` below a folder; the names written."""
    names = sorted(set(tables) - NOT_BACKED_UP)
    for name in names:
        tables[name].write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
    return names
