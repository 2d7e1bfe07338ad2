"""The supplied tables under the names and shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.paragraphs import paragraphs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: SQL of the same paragraphs.
PARAS = """paras AS (
  SELECT doc_id, i AS idx, printf('P%06d', i) AS pid, ps[i] AS text FROM (
    SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (
      SELECT doc_id, list_filter(regexp_split_to_array(text, '\\n+'), lambda x: trim(x, ' ') <> '') AS ps FROM documents)))"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their number of words."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))


WORDS = r"words AS (SELECT doc_id, lang, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS INT) AS words FROM documents)"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ledger entries: purchases charge their rounded value, all others grant a fifth of it."""
    e = table(spark, sf_dir, "events")
    amount = F.floor("value").cast("long")
    delta = F.when(F.col("event_type") == "purchase", -amount).otherwise(F.floor(amount / 5).cast("long"))
    return e.select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("entry_id"), delta.alias("delta"), "event_type", "value")


LEDGER = """ledger AS (SELECT user_id, ts AS tm, event_id AS entry_id, event_type, value,
  CASE WHEN event_type = 'purchase' THEN -CAST(floor(value) AS BIGINT) ELSE CAST(floor(CAST(floor(value) AS BIGINT) / 5) AS BIGINT) END AS delta FROM events)"""

PRICES = [("alpha", "2000-01-01", "0.3000", "2.5000", "0.0300", "0.500"), ("alpha", "2024-01-15", "0.6000", "5.0000", None, "0.500"),
          ("beta", "2000-01-01", "0.1000", "0.4000", "0.0250", "0.750"), ("beta", "2024-01-20", "0.1500", "0.6000", "0.0300", "1.000")]


def prices(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(PRICES, "model string, effective_from string, input_per_mtok string, output_per_mtok string, cached_input_per_mtok string, batch_multiplier string")
    money = {c: F.col(c).cast("decimal(10,4)") for c in ("input_per_mtok", "output_per_mtok", "cached_input_per_mtok")}
    return rows.withColumns(money | {"effective_from": F.to_date("effective_from"),
        "batch_multiplier": F.col("batch_multiplier").cast("decimal(4,3)")})


def _quoted(v: str | None) -> str:
    return "NULL" if v is None else f"'{v}'"


PRICES_SQL = ("prices AS (SELECT m AS model, CAST(f AS DATE) AS effective_from, CAST(i AS DECIMAL(10,4)) AS input_per_mtok, CAST(o AS DECIMAL(10,4)) AS output_per_mtok, "
              "CAST(c AS DECIMAL(10,4)) AS cached_input_per_mtok, CAST(b AS DECIMAL(4,3)) AS batch_multiplier FROM (VALUES "
              + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in PRICES) + ") AS t(m, f, i, o, c, b))")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model calls with token counts."""
    e = table(spark, sf_dir, "events")
    big = F.floor(F.col("value") * 1000).cast("long")
    return e.select(
        F.col("event_id").alias("call_id"), F.when(F.col("user_id") % 2 == 0, "alpha").otherwise("beta").alias("model"), F.to_date("ts").alias("day"),
        F.col("ts").alias("at"),
        big.alias("tokens_in"), F.floor(big / 3).cast("long").alias("tokens_cached"), F.floor(big / 10).cast("long").alias("tokens_out"),
        F.floor(big / 20).cast("long").alias("tokens_think"), (F.col("event_id") % 3 == 0).alias("batch"), "user_id")


CALLS = """calls AS (SELECT event_id AS call_id, CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS model, CAST(ts AS DATE) AS day, ts AS tm,
  CAST(floor(value * 1000) AS BIGINT) AS tokens_in, CAST(floor(value * 1000) AS BIGINT) // 3 AS tokens_cached, CAST(floor(value * 1000) AS BIGINT) // 10 AS tokens_out,
  CAST(floor(value * 1000) AS BIGINT) // 20 AS tokens_think, event_id % 3 = 0 AS batch, user_id FROM events)"""
COST = """round(CAST((greatest(tokens_in - tokens_cached, 0) * input_per_mtok + tokens_cached * coalesce(cached_input_per_mtok, input_per_mtok)
  + (tokens_out + tokens_think) * output_per_mtok) AS DECIMAL(38,4)) * CAST(0.000001 AS DECIMAL(7,6)) * CASE WHEN batch THEN batch_multiplier ELSE 1 END, 6)"""
PRICED = """priced AS (SELECT c.*, p.* EXCLUDE (model) FROM calls c JOIN prices p ON p.model = c.model AND p.effective_from <= c.day
  AND NOT EXISTS (SELECT 1 FROM prices q WHERE q.model = c.model AND q.effective_from <= c.day AND q.effective_from > p.effective_from))"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), status.alias("status"),
        (F.col("o_orderkey") % 7 == 0).alias("cancel_requested"),
                    F.when(F.col("o_orderpriority").startswith("1"), "private").otherwise("standard").alias("privacy"),
                    F.to_date("o_orderdate").alias("day"),
                    F.col("o_totalprice").alias("cost"))


JOBS = """jobs AS (SELECT o_orderkey AS job_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'succeeded' ELSE 'failed' END AS status,
  o_orderkey % 7 = 0 AS cancel_requested, CASE WHEN o_orderpriority LIKE '1%' THEN 'private' ELSE 'standard' END AS privacy, CAST(o_orderdate AS DATE) AS day,
  o_totalprice AS cost FROM orders)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tasks of jobs."""
    i = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_linenumber") % 3 == 0, "running").when(F.col("l_returnflag") == "R", "done").otherwise("pending")
    return i.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("task_id"), F.col("l_orderkey").alias("job_id"), status.alias("status"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_shipdate").alias("run_after"), (F.col("l_linenumber") % 4).cast("int").alias("attempt"), F.lit(3).alias("max_attempts"),
        F.col("l_shipdate").alias("heartbeat_at"),
        F.lit(None).cast("string").alias("error_code"), F.lit("w").alias("locked_by"), F.lit(None).cast("timestamp").alias("finished_at"))


TASKS = """tasks AS (SELECT l_orderkey * 10 + l_linenumber AS task_id, l_orderkey AS job_id, CASE WHEN l_linenumber % 3 = 0 THEN 'running' WHEN l_returnflag = 'R' THEN 'done'
  ELSE 'pending' END AS status, l_shipdate AS created_at, l_shipdate AS run_after, CAST(l_linenumber % 4 AS INT) AS attempt, 3 AS max_attempts, l_shipdate AS heartbeat_at FROM lineitem)"""
