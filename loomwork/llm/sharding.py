"""Proportional stratified interleaving: shards of equal row counts that each match the mixture of sources.

Rows are shuffled within each source by a seeded hash, a row's rank r of n in its source becomes the fraction
(r + 1/2) / n, all rows are put in the order of the fraction, and that order is cut into shards of equal counts.

No source is ever ordered by one task. A rank is the number of the source's rows in lower hash buckets, which is a
small table of counts, plus the row number within (source, bucket). The order of fractions is found likewise: how many
rows of a source of n lie below a fraction follows from n alone, so only rows of one slice of the fraction are sorted
together. Buckets and slices hold about ``ROWS`` rows each at any size.

Cases: a null source is a source of its own; a null text has no bytes; repeated rows are neighbours in their source
and get slots of their own; rows of one id, null too, are dealt by their texts; an empty table gives an empty result; further
columns stay, whatever their names, but ``shard`` and ``slot`` replace columns of that name. The law is ``rows``: counts are at most one apart, so equal texts are not kept together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm.common import small, table, written

SHARDS, SEED = 16, 20_261
#: Rows in a bucket or slice; the hash has 20 bits for the bucket.
ROWS, BITS = 20_000, 20


def interleaved(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows with ``shard`` and ``slot``; the position in all is the shard's first position plus the slot."""
    rows = rows.drop("shard", "slot")
    tie = F.col("text_crc32") if "text_crc32" in rows.columns else F.crc32(F.col("text").cast("binary"))
    # All that follows goes by names of its own; the row comes back whole.
    rows = rows.select(F.struct(*rows.columns).alias("row"), F.col("source").alias("source"), F.col("doc_id").alias("id"), tie.alias("tie"))
    total = rows.count()
    parts = max(1, min(2**BITS, -(-total // ROWS)))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "tie"), 1))
    rows = rows.withColumn("b", F.shiftright(F.shiftright("h", 63 - BITS) * F.lit(parts), BITS).cast("int"))

    by_source = Window.partitionBy("s")
    below = by_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col("source").alias("s"), F.col("b").alias("bucket")).agg(F.count("*").alias("inside"))
    before = F.coalesce(F.sum("inside").over(below), F.lit(0))
    counts = counts.select("s", "bucket", before.alias("before"), F.sum("inside").over(by_source).alias("n"))
    counts = written(counts, "shard-counts")
    within = Window.partitionBy("source", "b").orderBy("h", "id", "tie")
    ranked = rows.join(small(counts), rows["source"].eqNullSafe(counts["s"]) & (rows["b"] == counts["bucket"]))
    ranked = ranked.withColumn("r", F.col("before") + F.row_number().over(within) - 1)
    ranked = ranked.withColumns({"slice": F.expr(f"((2 * r + 1) * {parts}L) div (2 * n)"), "f": (F.col("r") + 0.5) / F.col("n")})

    # Of a source of n rows, those with (2 r + 1) * parts < 2 n k lie below slice k.
    sources = counts.select("s", "n").distinct()
    starts = sources.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    starts = starts.groupBy("k").agg(F.sum(F.expr(f"greatest(0L, (2 * n * k + {parts}L - 1) div (2 * {parts}L))")).alias("start"))
    starts = small(starts)
    sliced = ranked.join(starts, ranked["slice"] == starts["k"])
    order = Window.partitionBy("slice").orderBy("f", F.col("source").asc_nulls_last(), "h", "id", "tie")
    placed = sliced.withColumn("at", F.col("start") + F.row_number().over(order) - 1)
    total = max(total, 1)
    placed = placed.withColumn("shard", F.expr(f"int((at * {shards}L) div {total}L)"))
    slot = F.expr(f"at - (shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.select("row.*", "shard", slot.alias("slot"))


def op9_shard_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document; sizes and checksums are taken in one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = interleaved(written(docs, "shard-rows"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> list[int]:
    """What CRC-32 adds for each last byte, by its reversed polynomial."""
    out = []
    for a in range(256):
        for _ in range(8):
            a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
        out.append(a)
    return out


# The five primes of the 64-bit xxHash, and the seed that Spark's function begins with.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
SPARK_SEED = 42


def _hashed(step: int, before: str, value: str, width: int) -> str:
    """CTEs that mix one value of 4 or 8 bytes into a hash ``before`` as column ``h{step}``; numbers are unsigned, products are cut to 64 bits."""
    p1, p2, p3, p4, p5 = (f"CAST('{p}' AS UHUGEINT)" for p in PRIMES)
    cut = lambda x: f"(({x}) % CAST('{2**64}' AS UHUGEINT))"
    turned = lambda x, by: f"({cut(f'{x} * {2**by}::UHUGEINT')} | ({x} // {2**(64 - by)}::UHUGEINT))"
    fold = lambda x, by: f"xor({x}, {x} // {2**by}::UHUGEINT)"
    if width == 8:
        chain = [cut(f"v * {p2}"), cut(f"{turned('x', 31)} * {p1}"), f"xor({cut(f'{before} + {p5} + 8')}, x)", cut(f"{turned('x', 27)} * {p1} + {p4}")]
    else:
        chain = [cut(f"v * {p1}"), f"xor({cut(f'{before} + {p5} + 4')}, x)", cut(f"{turned('x', 23)} * {p2} + {p3}")]
    chain += [cut(f"{fold('x', 33)} * {p2}"), cut(f"{fold('x', 29)} * {p3}"), fold("x", 32)]
    signed = f"CASE WHEN {value} < 0 THEN CAST(CAST({value} AS HUGEINT) + CAST('{2**64}' AS HUGEINT) AS UHUGEINT) ELSE CAST({value} AS UHUGEINT) END"
    rows = f"(SELECT *, {signed} AS v, 0 AS x FROM s{step - 1})"
    for x in chain[:-1]:
        rows = f"(SELECT * EXCLUDE (x), {x} AS x FROM {rows})"
    return f"s{step} AS (SELECT * EXCLUDE (v, x), CASE WHEN {value} IS NULL THEN {before} ELSE {chain[-1]} END AS h{step} FROM {rows})"


#: A row's place follows from its rank alone, so one window over all rows says what the buckets and slices give.
ORACLE = f"""
WITH t AS (SELECT doc_id, source, encode(coalesce(text, '')) AS raw FROM documents),
s0 AS (
  SELECT doc_id, source, CAST(octet_length(raw) + 1 AS BIGINT) AS size, CAST({SEED} AS BIGINT) AS seed, CAST('{SPARK_SEED}' AS UHUGEINT) AS h0,
         xor(list_reduce(list_transform(regexp_extract_all(hex(raw), '..'), lambda x: CAST('0x' || x AS BIGINT)),
             lambda a, x: xor(a >> 8, {_crc_table()}[CAST(xor(a & 255, x) AS INT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
  FROM t),
{_hashed(1, 'h0', 'seed', 4)},
{_hashed(2, 'h1', 'doc_id', 8)},
{_hashed(3, 'h2', 'text_crc32', 8)},
r AS (
  SELECT *, h3 // 2 AS h, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total,
         row_number() OVER (PARTITION BY source ORDER BY h3 // 2, doc_id NULLS FIRST, text_crc32) - 1 AS r
  FROM s3),
p AS (
  SELECT *, row_number() OVER (ORDER BY (r + CAST(0.5 AS DOUBLE)) / n, source NULLS LAST, h, doc_id NULLS FIRST, text_crc32) - 1 AS place FROM r),
q AS (SELECT *, place * {SHARDS} // total AS s FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(s AS INT) AS shard, place - (s * total + {SHARDS - 1}) // {SHARDS} AS slot, CAST(NULL AS INT) AS grown_shard FROM q
"""
