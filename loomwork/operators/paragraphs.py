"""Documents as ordered paragraphs: scans, segments, contexts, ranges and repeated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_MAX, SEGMENT_MIN = 12_000, 2_500


def paragraphs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, idx, pid, text)``: the lines of a text that have words, numbered from 1."""
    lines = F.filter(F.split("text", r"\n+"), lambda x: F.trim(x) != "")
    rows = docs.select(key, F.posexplode(lines).alias("pos", "text"))
    return rows.select(key, (F.col("pos") + 1).alias("idx"), F.format_string("P%06d", F.col("pos") + 1).alias("pid"), "text")


def token_estimate(text: Column, per_token: float = 4.0) -> Column:
    return F.ceil(F.length(text) / per_token).cast("long")


def segments(paras: DataFrame, key: str = "doc_id", target: int = 8000, most: int = SEGMENT_MAX, least: int = SEGMENT_MIN) -> DataFrame:
    """``(key, segment, first_idx, last_idx, tokens)`` by greedy packing of a document's paragraphs.

    A segment is closed when the next paragraph would exceed the target and it has the least size; a paragraph above
    ``most`` stands alone; a last segment below the least size joins the one before. The sum starts anew at every cut,
    which no window frame expresses, so an array of a document's paragraph sizes is folded.
    """
    sizes = paras.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", token_estimate(F.col("text")).alias("t")))).alias("ps"))
    # The open segment is held apart, so the list of closed ones is copied once a segment and not once a paragraph.
    one = "struct<a:int,b:int,t:bigint>"
    alone = f"x.t > {most} OR acc.open.t > {most} AND acc.open.a = acc.open.b"
    grows = f"acc.open.t + x.t <= {target} OR acc.open.t < {least}"
    new = "named_struct('a', x.idx, 'b', x.idx, 't', x.t)"
    grow = "named_struct('done', acc.done, 'open', named_struct('a', acc.open.a, 'b', x.idx, 't', acc.open.t + x.t))"
    close = f"named_struct('done', array_append(acc.done, acc.open), 'open', {new})"
    begin = f"named_struct('done', cast(array() AS array<{one}>), 'open', cast(null AS {one}))"
    step = (f"CASE WHEN acc.open IS NULL THEN named_struct('done', acc.done, 'open', {new}) WHEN NOT ({alone}) AND ({grows}) THEN {grow} ELSE {close} END")
    fold = f"aggregate(ps, {begin}, (acc, x) -> {step}, acc -> array_append(acc.done, acc.open))"
    merged = (f"CASE WHEN size(s) > 1 AND element_at(s, -1).t < {least} THEN concat(slice(s, 1, size(s) - 2), array(named_struct("
              "'a', element_at(s, -2).a, 'b', element_at(s, -1).b, 't', element_at(s, -2).t + element_at(s, -1).t))) ELSE s END")
    rows = sizes.select(key, F.expr(fold).alias("s")).select(key, F.posexplode(F.expr(merged)).alias("pos", "x"))
    return rows.select(key, (F.col("pos") + 1).alias("segment"), F.col("x.a").alias("first_idx"), F.col("x.b").alias("last_idx"),
        F.col("x.t").alias("tokens"))


def context_before(paras: DataFrame, starts: DataFrame, key: str = "doc_id", n: int = 2) -> DataFrame:
    """``(key, segment, context)``: ids of the ``n`` paragraphs before a segment's first one; the first segment has none."""
    before = Window.partitionBy(key).orderBy("idx").rowsBetween(-n, -1)
    rows = paras.select(key, "idx", F.collect_list("pid").over(before).alias("context"))
    return starts.select(key, "segment", F.col("first_idx").alias("idx")).join(rows, [key, "idx"]).drop("idx")


def with_neighbours(cited: DataFrame, paras: DataFrame, key: str = "doc_id", reach: int = 1) -> DataFrame:
    """The cited paragraphs ``(key, idx)`` and their neighbours, once each: a band join as an equi-join."""
    near = cited.select(key, F.explode(F.sequence(F.col("idx") - reach, F.col("idx") + reach)).alias("idx")).distinct()
    return near.join(paras, [key, "idx"])


def labelled(paras: DataFrame, ranges: DataFrame, key: str = "doc_id", default: str = "core") -> DataFrame:
    """Paragraphs with the label of the first range ``(key, range_no, from_idx, to_idx, label)`` that covers them."""
    each = ranges.select(key, "range_no", "label", F.explode(F.sequence("from_idx", "to_idx")).alias("idx"))
    first = each.groupBy(key, "idx").agg(F.min_by("label", "range_no").alias("label"))
    return paras.join(first, [key, "idx"], "left").withColumn("label", F.coalesce("label", F.lit(default)))


def repeated_lines(paras: DataFrame, key: str = "doc_id", share: float = 0.4) -> DataFrame:
    """``(text, docs)``: lines on more than a share of all pages."""
    total = paras.select(key).distinct().count()
    counts = paras.groupBy("text").agg(F.count_distinct(key).alias("docs"))
    return counts.where(F.col("docs") > share * total)


def merged_cues(cues: DataFrame, key: str, gap: float = 2.0) -> DataFrame:
    """Cues ``(key, at, text)`` merged until a sentence ends or the silence exceeds ``gap`` seconds."""
    order = Window.partitionBy(key).orderBy("at")
    breaks = (F.col("at").cast("double") - F.lag(F.col("at").cast("double")).over(order) > gap) | F.lag("text").over(order).rlike(r"[.!?…]\s*$")
    rows = cues.withColumn("cue", F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(order))
    return rows.groupBy(key, "cue").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("parts"),
                                        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]),
                                        " ").alias("text"))


def rolled_out(cues: DataFrame, key: str) -> DataFrame:
    """Cues ``(key, at, text)`` without those that a rolling caption shows again: a line equal to the one before it, or its beginning."""
    after = F.lead("text").over(Window.partitionBy(key).orderBy("at"))
    return cues.withColumn("_next", after).where("_next IS NULL OR NOT startswith(_next, text)").drop("_next")


def windows(paras: DataFrame, key: str = "doc_id", size: int = 300_000, overlap: int = 10_000) -> DataFrame:
    """``(key, window, idx)``: paragraphs in windows of so many tokens; those that begin in a window's last ``overlap`` tokens are in the next one too."""
    order = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    at = paras.select(key, "idx", F.coalesce(F.sum(token_estimate(F.col("text"))).over(order), F.lit(0)).alias("at"))
    step = size - overlap
    last = F.expr(f"int(at div {step})")
    first = F.greatest(F.lit(0), F.expr(f"int((at - {size}) div {step}) + CASE WHEN at >= {size} THEN 1 ELSE 0 END"))
    return at.select(key, F.explode(F.sequence(first, last)).alias("window"), "idx").withColumn("window", F.col("window") + 1)


def window_terms(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Terms ``(key, window, term, occurrences)`` of overlapping windows once per document, as the window with the most occurrences has them."""
    best = F.struct(F.col("occurrences"), (-F.col("window")).alias("w"))
    return found.groupBy(key, "term").agg(F.max(best).alias("b")).select(key, "term", F.col("b.occurrences").alias("occurrences"),
        (-F.col("b.w")).alias("window"))


def extraction_quality(pages: DataFrame, key: str = "doc_id", scanned_below: int = 200) -> DataFrame:
    """``(key, median_chars, printable, scanned, quality)`` of pages ``(key, text, ocr)``.

    A document is a scan if its median page has under ``scanned_below`` characters. The score weighs printable
    characters (0.5), pages of a reasonable length (0.3) and pages that were not read by OCR (0.2).
    """
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    rows = pages.select(key, n.alias("n"), (n - F.length(F.regexp_replace(text, r"[\x00-\x08\x0e-\x1f\x{FFFD}]", ""))).alias("odd"),
        F.coalesce("ocr", F.lit(False)).alias("ocr"))
    found = rows.groupBy(key).agg(
        F.median("n").alias("median_chars"), (1 - F.sum("odd") / F.greatest(F.sum("n"), F.lit(1))).alias("printable"),
        F.avg((F.col("n") >= scanned_below).cast("int")).alias("_long"), F.avg(F.col("ocr").cast("int")).alias("_ocr"))
    quality = 0.5 * F.col("printable") + 0.3 * F.col("_long") + 0.2 * (1 - F.col("_ocr"))
    return found.select(key, "median_chars", "printable", (F.col("median_chars") < scanned_below).alias("scanned"), quality.alias("quality"))
