"""Numbers in running text: canonical forms, extraction, and those of a report that no source has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns: what counts as a number, a list mark and an internal id.
NUMBER = r"(?<![\p{L}\p{N}_])(\d{1,3}(?:[.,]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)(?![\p{L}\p{N}_])"
LIST_MARK = r"(?m)^[ \t]*\d+[.)][ \t]+"
IDS = r"\b(?:U-\d{4,}|P\d{6,}|S\d{2,}(?:\.b\d{2,})?|SEG-\d{3,})\b"
# English number words.
UNITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen",
         "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
NUMBER_WORDS = {w: i for i, w in enumerate(UNITS)} | {w: 10 * i for i, w in enumerate(TENS, 2)} | {"hundred": 100}


def canon_number(number: Column) -> Column:
    """One form for 1,000 and 1.000 (1000) or 3,5 and 3.50 (3.5): separators are told apart by count and place."""
    s = F.replace(F.trim(number), F.lit(" "), F.lit(""))
    return F.when(s.contains(",") | s.contains("."), _separated(s)).otherwise(_whole(s))


def _whole(digits: Column) -> Column:
    bare = F.ltrim(digits, F.lit("0"))
    return F.when(bare == "", "0").otherwise(bare)


def _separated(s: Column) -> Column:
    """The form of a number with commas or dots."""
    comma, dot = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit(""))), F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    joined = F.translate(s, ",.", "")
    # With both separators the later one marks the decimals.
    both = F.when(s.rlike(",[^.,]*$"), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit("")))
    grouped = F.when(comma + dot > 1, s.rlike(r"^[^.,]*([.,]\d{3})+$")).otherwise(s.rlike(r"^(?!0[.,])\d{1,3}[.,]\d{3}$"))
    plain = F.when((comma > 0) & (dot > 0), both).when(grouped, joined).otherwise(F.translate(s, ",", "."))
    # The parts before and after the first dot.
    parts = F.split(plain, r"\.", 2)
    part = F.rtrim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.lit("0"))
    return F.when(part == "", _whole(F.get(parts, F.lit(0)))).otherwise(F.concat(_whole(F.get(parts, F.lit(0))), F.lit("."), part))


def digits_for_words(text: Column) -> Column:
    """Number words as digits, in one pass over the text."""
    # By first letters, so that a word that is no number is left after a few looks.
    ends = {c: "|".join(w[1:] for w in sorted(NUMBER_WORDS, key=len, reverse=True) if w[0] == c) for c in sorted({w[0] for w in NUMBER_WORDS})}
    pattern = rf"(?i)\b({'|'.join(f'{c}(?:{e})' for c, e in ends.items())})\b"
    known = F.create_map(*(F.lit(x) for w, v in NUMBER_WORDS.items() for x in (w, str(v))))
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_join(F.zip_with(between, found, lambda s, w: F.concat(s, F.coalesce(F.element_at(known, F.lower(w)), F.lit("")))), "")


def bare_text(text: Column) -> Column:
    """The text without list marks and internal ids."""
    return F.regexp_replace(F.regexp_replace(text, LIST_MARK, ""), IDS, " ")


def numbers_of(bare: Column) -> Column:
    """Numbers in order as they are written."""
    return F.regexp_extract_all(bare, F.lit(NUMBER), F.lit(1))


def extract_numbers(text: Column, words: bool = False) -> Column:
    """Canonical numbers in order, without list marks and internal ids; with ``words`` number words count too."""
    t = bare_text(text)
    return F.transform(numbers_of(digits_for_words(t) if words else t), canon_number)


def unverified_numbers(reports: DataFrame, sources: DataFrame, key: str, min_value: float = 0) -> DataFrame:
    """``(key, number)`` of numbers in reports ``(key, text)`` that no source ``(key, text)`` of the key has.

    Numbers of both go through one exchange, by key and number; they are brought to one form as rows, each once.
    """
    # Rows without numbers leave after the explosion: a filter before it would look for the numbers twice.
    said = reports.select(key, F.explode_outer(numbers_of(bare_text(F.col("text")))).alias("number"))
    bare = sources.select(key, bare_text(F.col("text")).alias("text"))
    known = bare.select(key, F.explode_outer(F.array_union(numbers_of(F.col("text")), numbers_of(digits_for_words(F.col("text"))))).alias("number"))
    both = said.withColumn("known", F.lit(False)).unionByName(known.withColumn("known", F.lit(True))).where("number IS NOT NULL")
    both = both.withColumn("number", canon_number(F.col("number")))
    counts = F.coalesce(F.col("number").try_cast("double") >= min_value, F.lit(False))
    return both.groupBy(key, "number").agg(F.max(F.col("known") | ~counts).alias("known")).where("NOT known").drop("known")


def in_number_order(rows: DataFrame, number: str = "number") -> DataFrame:
    """Shorter numbers first, then by their characters."""
    return rows.orderBy(F.length(number), number)
