"""Benchmark decontamination: a hash set of normalised test n-grams, scanned over the windows of training texts.

Texts are lower-cased in A-Z and cut into words; a window is ``N`` consecutive words of an item, or all words of a
shorter item. A document word inside any occurrence of a window is hit.

The scan has two steps, both in the JVM. A window of L words anywhere in a text holds one whole block of
``b = ceil(L / 2)`` words that starts at a multiple of ``L - b + 1``; so one hash per such block, looked up in the hash
set of all blocks of the windows of that length, finds every text that can hold one, at about one hash per six words
for windows of ten. Each length has blocks of its own, so a short item costs a finer grid and not a candidate more. Only
the texts found are then scanned window by window, and each window is verified by its words.

Both lookups are joins: the set of hashes is broadcast up to ``SET_ROWS`` of them, the windows up to a number of bytes
that is measured first, and larger ones are joined by shuffle with the same result.

Cases: a null or empty text has no words and no hits; items without words have no windows; an item of one word is one window; repeated items and windows
count once; repeated documents get equal rows; empty tables give no hits; documents that share an id but not the text
are told apart by a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import ascii_lower, light, passing, small, table, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window, and the hashes of eight bytes that are broadcast.
N, SET_ROWS = 10, 1_000_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(items: DataFrame, n: int = N) -> DataFrame:
    """``(window, len, items)``: each distinct window with the ids of the items that hold it, as strings."""
    cut = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    cut = cut.withColumn("len", F.least(F.lit(n), F.size("w")))
    at = F.explode(F.expr("transform(sequence(1, size(w) - len + 1), i -> array_join(slice(w, i, len), ' '))"))
    return cut.select(at.alias("window"), "len", "item").groupBy("window", "len").agg(F.collect_set("item").alias("items"))


def block(length: int) -> tuple[int, int]:
    """Words of a block for windows of a length, and the step of the grid of which every window holds one."""
    size = -(-length // 2)
    return size, length - size + 1


def blocks_of(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """``(h)``: the distinct hashes of all blocks of the windows."""
    cut = windows.select(F.split("window", " ").alias("w"), "len")
    found = None
    for k in lengths:
        size, step = block(k)
        part = cut.where(F.col("len") == k).select(F.explode(F.expr(f"transform(sequence(1, {step}), i -> xxhash64(slice(w, i, {size})))")).alias("h"))
        found = part if found is None else found.union(part)
    return found.distinct()


def grid(lengths: list[int]) -> Column:
    """Hashes of the blocks of the words ``w`` that every window of these lengths holds one of."""
    parts = []
    for k in lengths:
        size, step = block(k)
        each = f"transform(sequence(1, size(w) - {size - 1}, {step}), i -> xxhash64(slice(w, i, {size})))"
        parts.append(f"CASE WHEN size(w) >= {k} THEN {each} ELSE cast(array() AS array<bigint>) END")
    return F.expr(f"concat({', '.join(parts)})")


def joined(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The documents joined with rows of ``_id`` and ``_key``, the document's id and the hash of its text."""
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["_id"]) & (F.xxhash64(docs["text"]) == keys["_key"]), how)


def candidates(docs: DataFrame, windows: DataFrame, lengths: list[int], set_rows: int = SET_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text_key, n_words)`` per document, and ``(_id, _key)`` of those that hold a block of a window."""
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    cut = written(cut.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), grid(lengths).alias("hs")), "bench-scan")
    known = small(written(blocks_of(windows, lengths), "bench-blocks"), set_rows)
    met = cut.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.explode("hs").alias("h")).join(known, "h", "left_semi")
    return cut.drop("hs"), written(met.select("_id", "_key").distinct(), "bench-candidates")


def hits_of(docs: DataFrame, windows: DataFrame, lengths: list[int], may: DataFrame) -> DataFrame:
    """``(_id, _key, n_hit, hit_items)`` of the candidates that do hold windows."""
    key = ["_id", "_key"]
    probe = joined(docs.select("doc_id", "text"), small(may), "left_semi")
    probe = probe.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), words(F.col("text")).alias("w")).dropDuplicates(key)
    at = None
    for k in lengths:
        each = f"transform(sequence(1, size(w) - {k} + 1), i -> struct(i AS pos, {k} AS len, array_join(slice(w, i, {k}), ' ') AS window))"
        part = probe.where(F.size("w") >= k).select(*key, F.explode(F.expr(each)).alias("x"))
        at = part if at is None else at.unionByName(part)
    found = light(windows, F.octet_length("window") + 16 * F.size("items"))
    hits = at.select(*key, "x.*").join(found, ["window", "len"]).groupBy(*key).agg(
        F.collect_set(F.struct("pos", "len")).alias("at"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("hit_items"))
    covered = "cast(size(array_distinct(flatten(transform(at, x -> sequence(x.pos, x.pos + x.len - 1))))) AS bigint)"
    return written(hits.select(*key, F.expr(covered).alias("n_hit"), "hit_items"), "bench-hits")


def scan(docs: DataFrame, items: DataFrame, n: int = N, set_rows: int = SET_ROWS) -> DataFrame:
    """``(doc_id, text_key, n_words, n_hit, hit_items)`` per document."""
    windows = written(benchmark_windows(items, n), "bench-windows")
    lengths = [r[0] for r in windows.select("len").distinct().orderBy("len").collect()]  # at most n of them
    none = F.array().cast("array<string>")
    if not lengths:
        return docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"),
                           F.lit(0).cast("long").alias("n_hit"), none.alias("hit_items"))
    cut, may = candidates(docs, windows, lengths, set_rows)
    hits = hits_of(docs, windows, lengths, may)
    hits = light(hits, 16 * F.size("hit_items"))
    same = cut["doc_id"].eqNullSafe(hits["_id"]) & (cut["text_key"] == hits["_key"])
    return cut.join(hits, same, "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.array_sort(F.coalesce("hit_items", none)).alias("hit_items"))


def report(docs: DataFrame, items: DataFrame, n: int = N, set_rows: int = SET_ROWS) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` per document."""
    with passing(docs.sparkSession):
        found = scan(docs, items, n, set_rows).select(
            "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
            F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
        return written(found, "bench-report", keep=True)


def clean(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """The documents without a benchmark window, with the columns they came with."""
    with passing(docs.sparkSession):
        hit = scan(docs, items, n).where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
        hit = written(hit, "bench-hit", keep=True)
    return joined(docs, small(hit), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS win
  FROM (SELECT item, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
p AS (
  SELECT rid, i, l, array_to_string(w[i:i + l - 1], ' ') AS win
  FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
h AS (SELECT p.rid, p.i, p.l, bw.item FROM p JOIN bw ON p.win = bw.win AND p.l = bw.l),
c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS pos FROM h) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN it USING (rid)
"""
