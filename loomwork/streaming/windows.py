"""Windows over event time; the functions take streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def rolling_rates(calls: DataFrame, length: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``(start, end, n, limited, rate)`` of calls ``(ts, status)``: the share of 429 in sliding windows."""
    rows = calls.withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w"))
    rows = rows.agg(F.count("*").alias("n"), F.count_if(F.col("status") == 429).alias("limited"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "limited", (F.col("limited") / F.col("n")).alias("rate"))


def over_limit(requests: DataFrame, key: str, limit: int, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``(key, start, n, retry_after)``: windows in which a key made more requests than allowed, and the rest of the window in seconds."""
    rows = requests.withWatermark("ts", late).groupBy(key, F.window("ts", length).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    rest = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp("last")
    return rows.where(F.col("n") > limit).select(key, F.col("w.start").alias("start"), "n", rest.alias("retry_after"))


def sessions(events: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """``(key, start, end, n)``: events of a key no further apart than the gap."""
    rows = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tail(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append a folder's new Parquet events to another, from where the checkpoint left off; a restart repeats none."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation",
        checkpoint).outputMode("append").trigger(availableNow=True).start()
