"""Mix sources to target weights: repetition rates per source, whole copies plus one seeded Bernoulli copy.

Tokens (here: words) are summed per source, a target per source is derived from the weights, and a document is
taken ``floor(rate)`` times plus once more with the fraction as probability, where rate = target / source size.
The chance is drawn from a hash of the seed, the id and the text's length in bytes, so reruns agree.

Only the table of sources is joined to the documents. It is broadcast when a count finds it small and shuffled
otherwise; the sums are combined before the shuffle, so a source with a third of all rows costs no more than another.

Cases: a null or empty text has size 0 and adds nothing; a null source is a source of its own, the last; repeated
rows are drawn alike; an empty table gives an empty result; ``mix`` gives back every column as it came, whatever its name,
and the reports replace columns of a clashing name by the operator's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm.common import small, table, word_count, written

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix-1"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target, rate)``.

    Weights repeat along the sources in code point order. All sizes together are shared out by weight; a target stops
    at ``cap`` times its source's size and the excess goes to the others by weight. In the order of cap / weight the
    capped sources come first, so the level that the others reach is the greatest of
    (all - caps before) / weights from here on.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    known = sizes.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * cap).alias("_cap"))
    fill = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before, all_rows = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    level = known.withColumn("_level", left.cast("double") / F.sum("_w").over(onward).cast("double"))
    share = F.col("_w").cast("double") * F.max("_level").over(all_rows)
    target = F.when(F.col("_cap").cast("double") <= share, F.col("_cap").cast("double")).otherwise(share)
    target = level.select("source", "source_size", target.alias("target"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return target.withColumn("rate", rate)


def chance(*keys: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the keys."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def copies(rate: Column, draw: Column) -> Column:
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def with_copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The rows, which have ``doc_id``, ``source``, ``size`` and ``n_bytes``, with ``source_size, target, copies``."""
    docs = docs.drop("source_size", "target", "rate", "copies")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = small(written(source_targets(sizes, weights, cap), "mix-rates").withColumnRenamed("source", "_source"))
    mixed = docs.join(rates, docs["source"].eqNullSafe(rates["_source"])).drop("_source")
    return mixed.withColumn("copies", copies(F.col("rate"), chance(F.col("doc_id"), F.col("n_bytes"), seed=seed))).drop("rate")


def measured(docs: DataFrame) -> DataFrame:
    size, n_bytes = word_count(F.col("text")), F.coalesce(F.octet_length("text"), F.lit(0))
    return docs.drop("size", "n_bytes").withColumns({"size": size, "n_bytes": n_bytes})


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Every document as many times as the mix takes it, with the columns it came with."""
    packed = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))
    mixed = with_copies(measured(packed), weights, cap, seed).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, from one pass over the texts."""
    docs = measured(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "n_bytes")
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return with_copies(written(docs, "mix-sizes")).select("doc_id", "size", "source_size", "target", taken)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(strlen(text), 0) AS n_bytes
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 3 * source_size AS cap,
         [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS w
  FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), CAST(w AS DOUBLE) * max(level) OVER ()) AS target FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5(concat_ws(':', 'mix-1', coalesce(CAST(d.doc_id AS VARCHAR), ''),
           CAST(d.n_bytes AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM r
"""
