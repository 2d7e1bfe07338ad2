"""Text functions for matching; all are built-in expressions but for Unicode composition, which Spark has not."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that matching treats alike.
QUOTES_FROM, QUOTES_TO = "‘’‚‛“”„«»", "''''\"\"\"\"\""
DASHES_FROM, DASHES_TO = "–—−‐‑", "-----"
SPACES_FROM, SPACES_TO = "   ", "   "
SOFT_HYPHEN, ELLIPSIS = "­", "…"
WORD_CHAR = r"[\p{L}\p{N}_]"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition (NFC)."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def strip_diacritics(text: pd.Series) -> pd.Series:
    """Letters without their marks, and d for the barred d."""

    def bare(t: str) -> str:
        parts = unicodedata.normalize("NFD", t.replace("đ", "d").replace("Đ", "D"))
        return "".join(c for c in parts if unicodedata.category(c) != "Mn")

    return text.map(bare, na_action="ignore")


def fold(text: Column) -> Column:
    """Caseless form."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


#: Letters with marks by their parts: what Unicode composes.
COMPOSED = {unicodedata.normalize("NFD", c): c for c in map(chr, range(0xC0, 0x2000)) if unicodedata.normalize("NFC",
    unicodedata.normalize("NFD", c)) == c and unicodedata.decomposition(c)}


def composed(text: Column) -> Column:
    """Letters and their marks as one character where there is one, by built-in functions; texts without marks stay as they are."""
    known = F.from_json(F.lit(json.dumps(COMPOSED)), "map<string,string>")
    pair = lambda m: F.concat(F.element_at(known, F.substring(m, 1, 2)), F.substring(m, 3, 1_000_000))
    whole = lambda m: F.coalesce(F.element_at(known, m), pair(m), m)
    between, found = F.split(text, r"\p{L}\p{M}+", -1), F.regexp_extract_all(text, F.lit(r"(\p{L}\p{M}+)"), F.lit(1))
    joined = F.array_join(F.zip_with(between, found, lambda s, m: F.concat(s, F.coalesce(whole(m), F.lit("")))), "")
    return F.when(text.rlike(r"\p{M}"), joined).otherwise(text)


def norm_for_match(text: Column) -> Column:
    """Composed text with line-end hyphens joined, quotes, dashes and blanks unified, one space between words, caseless."""
    t = F.replace(composed(text), F.lit(SOFT_HYPHEN), F.lit(""))
    t = F.regexp_replace(t, rf"({WORD_CHAR})-[ \t]*\n[ \t]*({WORD_CHAR})", "$1$2")  # before dashes are unified
    t = F.translate(t, QUOTES_FROM + DASHES_FROM + SPACES_FROM, QUOTES_TO + DASHES_TO + SPACES_TO)
    t = F.replace(t, F.lit(ELLIPSIS), F.lit("..."))
    return fold(F.trim(F.regexp_replace(t, r"\s+", " ")))


def norm_loose(text: Column) -> Column:
    """Caseless letters and digits only, of the composed text."""
    return F.regexp_replace(fold(composed(text)), r"[^\p{L}\p{N}]+", "")


def letters(text: Column) -> Column:
    """Lower-case letters and digits only, each character by itself."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def slugify(text: Column, limit: int = 60) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, limit), "-+$", "")


def whole_word(term: Column, plural: bool = False) -> Column:
    """A pattern for the literal term between word boundaries, which may end in s or es."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.lit(rf"(?<!{WORD_CHAR})"), quoted, F.lit("(?:s|es)?" if plural else ""), F.lit(rf"(?!{WORD_CHAR})"))


def marked_share(text: Column) -> Column:
    """Share of letters that bear a diacritic, by the letters beyond ASCII."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^\p{L}]+|[A-Za-z]+", "")) / letters).otherwise(F.lit(0.0))


def cell(text: Column) -> Column:
    """Text for one cell of a table row."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("|"), F.lit("/")), r"\s+", " "))


def without_angles(text: Column) -> Column:
    return F.trim(F.translate(text, "<>", "‹›"))


def without_html(text: Column) -> Column:
    """Text without tags, scripts, styles and comments, with blanks unified."""
    bare = F.regexp_replace(text, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[a-z/!][^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def markdown_problems(text: Column) -> Column:
    """What a report's Markdown may not hold: html, images, links, code fences and headings above the third level."""
    rules = {"html": r"(?i)</?[a-z][^>]*>", "image": r"!\[[^\]]*\]\(", "link": r"(^|[^!])\[[^\]]*\]\(|https?://", "code": r"```",
        "heading": r"(?m)^#{1,2} "}
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in rules.items())), lambda x: x.isNotNull())
