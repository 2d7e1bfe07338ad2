"""Estimates of tokens, cost, credits, time and calls for a source of so many words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Starting constants of the estimates, by level.
WORDS_PER_PAGE, TOKENS_PER_TARGET_WORD = 300, 1.8
TOKENS_PER_WORD = {"en": 1.35, "vi": 1.6}
TOKENS_PER_WORD_OTHER = 1.4
LEVELS = {
    "full_translation": {"input_x": 2.15, "fixed_x": 0.02, "think": 1.10, "credit": 1.20, "serial": 1.0, "budget": None},
    "detailed_synthesis": {"input_x": 4.60, "fixed_x": 0.62, "think": 1.30, "credit": 1.35, "serial": 2.5, "budget": (0.35, 1500, 24000)},
    "deep_synthesis": {"input_x": 4.05, "fixed_x": 0.49, "think": 1.30, "credit": 1.00, "serial": 2.5, "budget": (0.12, 800, 9000)},
    "executive_brief": {"input_x": 3.00, "fixed_x": 0.40, "think": 1.30, "credit": 0.70, "serial": 2.0, "budget": (0.03, 250, 1500)},
}
TOKENS_PER_SECOND, STREAMS = 120.0, 6
WORDS_PER_PARAGRAPH, KEEP_TOKENS = 60, 14
SEGMENT_TOKENS, GLOSSARY_TOKENS, WORDS_PER_SECTION = 8000, 300_000, 500


def by_level(level: Column, name: str) -> Column:
    """A level's constant."""
    out = F.lit(None).cast("double")
    for key, values in LEVELS.items():
        out = F.when(level == key, F.lit(float(values[name]))).otherwise(out)
    return out


def source_tokens(words: Column, lang: Column) -> Column:
    rate = F.lit(TOKENS_PER_WORD_OTHER)
    for key, value in TOKENS_PER_WORD.items():
        rate = F.when(lang == key, F.lit(value)).otherwise(rate)
    return words * rate


def report_budget_words(words: Column, level: Column) -> Column:
    """Target length: a share of the source within bounds, at most four fifths of it and never under 100 words."""
    out = words.cast("long")
    most = F.greatest(F.lit(100), F.floor(words * 0.8))
    for key, values in LEVELS.items():
        if values["budget"]:
            share, low, high = values["budget"]
            out = F.when(level == key, F.least(F.lit(high), F.greatest(F.lit(low), F.bround(words * share)), most).cast("long")).otherwise(out)
    return out


def estimate(words: Column, level: Column, lang: Column, in_price: Column, out_price: Column) -> Column:
    """A struct of tokens, cost, credits and the range of minutes."""
    t = source_tokens(words, lang)
    tokens_in = by_level(level, "input_x") * t
    tokens_out = by_level(level, "think") * (by_level(level, "fixed_x") * t + report_budget_words(words, level) * TOKENS_PER_TARGET_WORD)
    cost = tokens_in / 1e6 * in_price + tokens_out / 1e6 * out_price
    credits = F.greatest(F.lit(1), F.ceil(words / WORDS_PER_PAGE * by_level(level, "credit")))
    minutes = by_level(level, "serial") + tokens_out * 2.0 / (TOKENS_PER_SECOND * STREAMS * 60.0)
    return F.struct(
        F.bround(tokens_in).cast("long").alias("tokens_in"), F.bround(tokens_out).cast("long").alias("tokens_out"),
        F.bround(cost, 4).alias("cost_usd"),
        credits.cast("long").alias("credits"), F.bround(minutes * 0.7, 1).alias("minutes_low"), F.bround(minutes * 1.8, 1).alias("minutes_high"))


def estimate_translation(words: Column, mode: Column, lang: Column, in_price: Column, out_price: Column, keep: float = 0.7,
        segment: int = 4000) -> Column:
    """Tokens, cost and calls of translating directly or by editing a draft, wholly or where needed."""
    p = LEVELS["full_translation"]
    t, v = source_tokens(words, lang), words * TOKENS_PER_TARGET_WORD
    tokens_in = t * p["input_x"] + F.when(mode == "direct", 0.0).otherwise(v)
    written = F.when(mode == "postedit_selective", v * (1 - keep) + words / WORDS_PER_PARAGRAPH * keep * KEEP_TOKENS).otherwise(v)
    tokens_out = (t * p["fixed_x"] + written) * p["think"]
    calls = F.ceil(F.greatest(F.lit(1), F.ceil(t / segment)) * 1.1)
    return F.struct(
        F.bround(tokens_in).cast("long").alias("tokens_in"), F.bround(tokens_out).cast("long").alias("tokens_out"),
        F.bround(tokens_in / 1e6 * in_price + tokens_out / 1e6 * out_price, 4).alias("cost_usd"), calls.cast("long").alias("llm_calls"))


def estimate_calls(words: Column, level: Column, lang: Column, window_scale: float = 1.0, verify_batch: int = 1) -> Column:
    """Model calls of a job: reading, glossary, writing, checks and repairs."""
    t = source_tokens(words, lang)
    glossary = F.greatest(F.lit(1), F.ceil(t / (GLOSSARY_TOKENS * window_scale)))
    translation = F.ceil(1 + glossary + F.ceil(t / min(4000 * window_scale, 8000)) * 1.1)
    reads = F.ceil(t / (SEGMENT_TOKENS * window_scale))
    sections = F.least(F.lit(20), F.greatest(F.lit(4), F.bround(report_budget_words(words, level) / WORDS_PER_SECTION))).cast("double")
    checks = F.ceil(sections / verify_batch) + F.ceil(sections * 0.5 / verify_batch)
    synthesis = F.ceil(1 + glossary + reads * 1.1 + 1 + sections + checks + sections * 0.6 + 1)
    return F.when(level == "full_translation", translation).otherwise(synthesis).cast("long")


def docs_per_day(calls_cap: Column, tokens_cap: Column, calls: Column, tokens: Column) -> Column:
    """How many documents a day's capacity allows; unknown capacities do not bound."""
    return F.coalesce(F.least(calls_cap / calls, tokens_cap / tokens), F.lit(float("inf")))


def backoff(base: float, failures: Column, cap: float = 600.0) -> Column:
    """Seconds to wait after so many failures in a row."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), failures - 1))
