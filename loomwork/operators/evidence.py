"""Quotes held against the paragraphs that they name."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomwork.functions.text import letters, norm_for_match, norm_loose

FUZZY_MIN_LEN, FUZZY_SCORE = 25, 95.0
#: Letters in the blocks by which near stretches are found.
BLOCK = 5
GOOD, BAD = ("exact", "loose", "fuzzy"), ("missing", "unknown_pid")


def near_windows(a: str, b: str, share: float) -> Iterable[tuple[int, int]]:
    """Stretches (start, end) of ``b`` that may be as similar to ``a`` as the share: as long as ``a``, or cut off by an end of ``b``.

    At most ``(1 - share) * 2 * len(a)`` letters of both are then unmatched. Each touches one block of ``a``, and a block
    that none touches stands in ``b``, moved by no more than their number: a stretch needs that many blocks near their
    places. Where differences could touch all blocks, all stretches are tried.
    """
    n, odd = len(a), int(2 * (1 - share) * len(a) + 1e-9)
    starts, last = range(0, n - BLOCK + 1, BLOCK), len(b) - n + odd
    if len(starts) > odd:
        votes: Counter[int] = Counter()
        for i in starts:
            near: set[int] = set()
            p = b.find(a[i : i + BLOCK])
            while p >= 0:
                near.update(range(max(0, p - i - odd), min(last, p - i + odd) + 1))
                p = b.find(a[i : i + BLOCK], p + 1)
            votes.update(near)
        found = [w for w, k in votes.items() if k >= len(starts) - odd]
    else:
        found = range(max(0, last) + 1)
    for w in found:
        yield w, w + n
        if w == 0:
            yield from ((0, end) for end in range(max(0, n - odd), n))


def best_ratio(a: str, b: str, least: float) -> float:
    """The best similarity, 0 to 100, of the shorter text to a stretch of the longer one; 0 if it is below ``least``.

    Similarity is twice the longest common subsequence over the letters of both. It is taken bit by bit: a bit of ``row``
    is cleared where the subsequence grows.
    """
    a, b = sorted((a, b), key=len)
    n, full, masks, top = len(a), (1 << len(a)) - 1, {}, 0.0
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    for begin, end in near_windows(a, b, least / 100):
        row, stretch = full, b[begin:end]
        for c in stretch:
            met = row & masks.get(c, 0)
            row = (row + met | row - met) & full
        top = max(top, 200 * (n - row.bit_count()) / max(1, n + len(stretch)))
    return top if top >= least else 0.0


@F.pandas_udf(DoubleType())
def partial_ratio(short: pd.Series, long: pd.Series) -> pd.Series:
    """``best_ratio`` from ``FUZZY_SCORE`` on; null where a text is."""
    return pd.Series([None if a is None or b is None else best_ratio(a, b, FUZZY_SCORE) for a, b in zip(short, long, strict=True)], dtype="float64")


def quote_status(quote: Column, paragraph: Column, loose: Column) -> Column:
    """exact, loose or missing against a paragraph's two normal forms; unknown_pid if there is none."""
    nq, lq = norm_for_match(quote), norm_loose(quote)
    return (F.when(paragraph.isNull(), "unknown_pid").when(nq == "", "missing").when(paragraph.contains(nq), "exact")
            .when((lq != "") & loose.contains(lq), "loose").otherwise("missing"))


def verified(evidence: DataFrame, paras: DataFrame, keys: list[str], fuzzy: bool = False) -> DataFrame:
    """Evidence ``(keys.., quote)`` with ``status`` and ``score`` against paragraphs ``(keys.., text)``.

    A paragraph that evidence names is normalised once and meets its quotes by an equi-join. With ``fuzzy`` (for scans
    with reading errors) missing quotes that are long enough and have no digits that the paragraph lacks are compared in
    Python; only those rows go there that share a block of characters with the paragraph, which a quote of enough
    similarity must: fewer than one block in two is touched by its differences. Where folding makes more or fewer letters
    of a text (ß is ss), its plain letters are compared too, so that one misread counts once; the better score holds. A
    missing quote scores 0.
    """
    named = paras.join(evidence.select(*keys).distinct(), keys, "left_semi")
    named = named.select(*keys, norm_for_match(F.col("text")).alias("_n"), norm_loose(F.col("text")).alias("_l"), *([F.col("text").alias("_t")] if fuzzy else []))
    if fuzzy:
        named = named.withColumn("_t", F.nullif(letters(F.col("_t")), F.col("_l")))
    rows = evidence.join(named, keys, "left").withColumn("status", quote_status(F.col("quote"), F.col("_n"), F.col("_l")))
    sure = F.when(F.col("status").isin("exact", "loose"), 100.0).otherwise(0.0)
    if not fuzzy:
        return rows.withColumn("score", sure).drop("_n", "_l")
    digits = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))
    rows = rows.withColumns({"_q": norm_loose(F.col("quote")), "_p": letters(F.col("quote")), "_t": F.coalesce("_t", "_l")})
    worth = (F.col("status") == "missing") & (F.length("_q") >= FUZZY_MIN_LEN)
    worth &= F.size(F.array_except(digits(F.col("quote")), digits(F.col("_n")))) == 0

    def near(q: str, t: str) -> Column:
        blocks = F.sequence(F.lit(1), F.greatest(F.length(q) - BLOCK + 1, F.lit(1)), F.lit(BLOCK))
        return F.exists(blocks, lambda i: F.col(t).contains(F.substr(q, i, F.lit(BLOCK))))

    other = (F.col("_p") != F.col("_q")) | (F.col("_t") != F.col("_l"))
    rows = rows.withColumns({"_worth": F.coalesce(worth & near("_q", "_l"), F.lit(False)), "_plain": F.coalesce(worth & other & near("_p", "_t"), F.lit(False))})
    # One pass: texts of the other rows go to Python as nulls.
    ratio = lambda on, q, t: F.coalesce(partial_ratio(F.when(F.col(on), F.col(q)), F.when(F.col(on), F.col(t))), F.lit(0.0))
    rows = rows.withColumn("score", F.greatest(sure, ratio("_worth", "_q", "_l"), ratio("_plain", "_p", "_t")))
    status = F.when((F.col("_worth") | F.col("_plain")) & (F.col("score") >= FUZZY_SCORE), "fuzzy").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("_n", "_l", "_t", "_q", "_p", "_worth", "_plain")


def unit_verified(results: DataFrame, *keys: str) -> DataFrame:
    """``(keys.., verified, bad_ratio)``: at least one good quote, and the share of bad ones."""
    return results.groupBy(*keys).agg(F.bool_or(F.col("status").isin(*GOOD)).alias("verified"),
        F.avg(F.col("status").isin(*BAD).cast("int")).alias("bad_ratio"))
