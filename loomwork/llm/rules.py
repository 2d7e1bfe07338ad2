"""Quality rules with risk-controlled thresholds.

Each rule rejects a document when a statistic of its text exceeds a cutoff. The cutoffs of all rules are chosen together
per stratum (language) by tests in a fixed sequence. Half of the labelled documents, by a hash of the id, only decide
the sequence: from no rule at all, each step tightens the one rule by one cutoff that rejects the most further bad
documents by good ones (and the fewest good ones where none are bad). On the other half each step is tested in turn: an
exact binomial test must reject, at the corrected level, that the rules together would wrongly reject more than
``ALPHA`` of the good documents. The first step that fails ends the sequence and the last one that passed is used.

No correction is due for the steps, as a sequence stops at its first failure, so the level is divided among the strata
only: with probability 1 - ``DELTA`` no stratum loses more than ``ALPHA`` of its good documents. A language with too few
good labels for any step to pass (458 at one per cent of four languages and the pool) shares one pooled stratum with the
others of its like; how many labels there are decides that, not what they say.

The exact test: with k of n good documents rejected, P(Binomial(n, rate) <= k) <= level, which is the same as the
Clopper-Pearson upper bound at that level being at most the rate.

One pass over the texts takes the statistics, which are written and then both calibrated on and judged. A stratum's
labels are gathered as counts by how many cutoffs of each rule a document exceeds: some thousands of rows at any size.

Cases: null and empty texts have no words and fail the base rule; a null language is a stratum of its own; a language
without labels uses no cutoffs; labels that repeat or clash count a document as good only if all its labels are;
repeated documents get equal verdicts; further columns are ignored, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import passing, small, table, written

ALPHA, DELTA = 0.01, 0.05
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
#: Statistic by rule, and the cutoffs from which one is chosen; a document above the cutoff is rejected.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0)),
    "repeats": ("n_repeat_words / n_words", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4)),
    "lines": ("n_dup_lines / n_words", (0.002, 0.005, 0.01, 0.02, 0.05)),
    "long_words": ("word_chars / n_words", (8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
}
STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")] if "\n" in text else [text]
    return n, chars, symbols, (len(lines) - len(set(lines)) if n else 0), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter([ids.setdefault(x, len(ids)) for x in words], np.int64, n)
    pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
    _, which, times = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    hit = times[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in STATISTICS.split(", ")]
        for rows in batches:
            found = pd.DataFrame([text_statistics(t) for t in rows["text"]], columns=names, index=rows.index)
            yield pd.concat([rows[keep], found], axis=1)

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInPandas(measure, f"{schema}, {STATISTICS}")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def at_most(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exactly summed in logarithms."""
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
            for i in range(min(k, n) + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def needed(level: float, alpha: float) -> int:
    """The least number of good documents of which none rejected passes the test."""
    return math.ceil(math.log(level) / math.log1p(-alpha))


def sequence(chosen: pd.DataFrame) -> Iterator[list[int]]:
    """The steps to test, from counts ``(exceeded by rule.., good, n)``: by rule, how many cutoffs a document must exceed to be rejected."""
    over = chosen[list(RULES)].to_numpy()
    n, good = chosen["n"].to_numpy(), chosen["good"].to_numpy(bool)
    bar = [len(cutoffs) + 1 for _, cutoffs in RULES.values()]
    left = np.ones(len(chosen), bool)
    while any(b > 1 for b in bar):
        best = None
        for r, b in enumerate(bar):
            if b > 1:
                new = left & (over[:, r] >= b - 1)
                kept, gone = int(n[new & good].sum()), int(n[new & ~good].sum())
                key = (-gone / (kept + 1), kept, r)
                best = min(best, (key, r)) if best else (key, r)
        r = best[1]
        bar[r] -= 1
        left &= over[:, r] < bar[r]
        yield list(bar)


def certified(counts: pd.DataFrame, level: float, alpha: float) -> list[int] | None:
    """The last step that passes its test; counts ``(exceeded by rule.., good, tested, n)`` of one stratum."""
    tested = counts[counts["tested"] & counts["good"]]
    over, n = tested[list(RULES)].to_numpy(), tested["n"].to_numpy()
    total, found = int(n.sum()), None
    for bar in sequence(counts[~counts["tested"]]):
        k = int(n[(over >= np.array(bar)).any(1)].sum()) if len(tested) else 0
        if k > total * alpha or at_most(k, total, alpha) > level:
            break
        found = bar
    return found


def cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``(stratum, rule, cutoff)``: the cutoffs in use by language."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("quality"), F.max(F.coalesce("toxic", F.lit(1))).alias("toxic"))
    known = known.select("doc_id", F.expr("quality = 1 AND toxic = 0").alias("good"))
    held = stats.where(~base_failed()).join(known, "doc_id")
    exceeded = [F.expr(f"size(filter(array({', '.join(f'{c}D' for c in cs)}), c -> {s} > c))").alias(r) for r, (s, cs) in RULES.items()]
    tested = (F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 1).alias("tested")
    counts = held.select("lang", "good", tested, *exceeded).groupBy("lang", "good", "tested", *RULES).agg(F.count("*").alias("n"))
    counts = written(counts, "rule-counts")
    sizes = counts.groupBy("lang").agg(F.sum(F.when(F.col("good") & F.col("tested"), F.col("n")).otherwise(0)).alias("good"))
    level = delta / (sizes.count() + 1)
    alone = F.col("good") >= needed(level, alpha)
    strata = sizes.select(F.col("lang").alias("stratum"), F.when(alone, F.concat(F.lit("of "), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("none")))).otherwise("pool").alias("_s"))
    strata = small(strata)

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bar = certified(rows, level, alpha)
        used = [(key[0], r, cs[b - 1]) for (r, (_, cs)), b in zip(RULES.items(), bar or (), strict=False) if b <= len(cs)]
        return pd.DataFrame(used, columns=["_s", "rule", "cutoff"])

    by = counts.join(strata, counts["lang"].eqNullSafe(strata["stratum"]))
    chosen = by.groupBy("_s").applyInPandas(choose, "_s string, rule string, cutoff double")
    return strata.join(chosen, "_s").select("stratum", "rule", "cutoff")


def judged(stats: DataFrame, chosen: DataFrame) -> DataFrame:
    """The statistics with ``base_failed`` and ``kept``."""
    wide = chosen.groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff"))
    wide = small(wide.select(F.col("stratum").alias("_stratum"), *(F.col(r).alias(f"_{r}") for r in RULES)))
    over = F.lit(False)
    for r, (statistic, _) in RULES.items():
        over |= F.coalesce(F.expr(statistic) > F.col(f"_{r}"), F.lit(False))
    both = stats.join(wide, stats["lang"].eqNullSafe(wide["_stratum"]), "left")
    return both.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over)


def op5_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    with passing(spark):
        stats = written(with_statistics(table(spark, sf_dir, "documents"), ["doc_id", "lang"]), "rule-statistics")
        done = judged(stats, cutoffs(stats, table(spark, sf_dir, "labels")))
        columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
        return written(done.select(*columns), "rule-report", keep=True)
