"""Key declarations: splitting pasted keys, judging and masking them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a key that was never filled in looks like, and the marks that may surround a pasted key.
PLACEHOLDER = (r"(?i)^(x+|\*+|\.+|….*|your[-_ ]?(api[-_ ]?)?key.*|api[-_ ]?key|key\d*|todo|changeme|dán.*|paste.*|<.*>|\{.*\}|.*(\.\.\.|…).*)$")
AROUND = "\"'`“”‘’[](){}<>"


def split_keys(text: Column) -> Column:
    """Structs (label, key) of pasted keys parted by commas, semicolons or white space.

    ``label|key`` and ``NAME=key`` (with a key of 8 characters at least) carry labels; a leading Bearer is dropped.
    """
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\ufeff", ""), r"\s*([|=])\s*", "$1")
    bare = lambda p: F.trim(F.btrim(F.trim(p), F.lit(AROUND)))
    parts = F.filter(F.transform(F.split(t, r"[,;\s]+"), bare), lambda p: (p != "") & (F.lower(p) != "bearer"))

    def one(p: Column) -> Column:
        piped, named = p.contains("|"), p.rlike(r"^[A-Za-z_][A-Za-z0-9_]*=(?!=+$).{8,}$")
        label = F.when(piped, F.substring_index(p, "|", 1)).when(named, F.substring_index(p, "=", 1))
        key = F.when(piped, F.regexp_replace(p, r"^[^|]*\|", "")).when(named, F.regexp_replace(p, "^[^=]*=", "")).otherwise(p)
        return F.struct(F.nullif(label, F.lit("")).alias("label"), bare(key).alias("key"))

    return F.transform(parts, one)


def classify_secret(secret: Column, key_pattern: str | None = None, min_len: int = 16) -> Column:
    """ok, too_short, invalid or placeholder: the first rule that applies."""
    chars = F.filter(F.split(secret, ""), lambda c: c != "")
    kinds = F.array_distinct(chars)
    most = F.array_max(F.transform(kinds, lambda k: F.size(F.filter(chars, lambda c: c == k))))
    out = (
        F.when(F.length(secret) < min_len, "too_short")
        .when(secret.rlike(r"[\s\x00-\x1f]|[^\x21-\x7e]"), "invalid")
        .when(secret.rlike(PLACEHOLDER) | (F.size(kinds) <= 3) | (most > F.length(secret) * 0.6), "placeholder"))
    return (out.when(~secret.rlike(f"^(?:{key_pattern})$"), "invalid") if key_pattern else out).otherwise("ok")


def masked(secret: Column) -> Column:
    return F.when(F.length(secret) < 8, "****").otherwise(F.right(secret, F.lit(4)))


def judged_keys(keys: DataFrame, existing: DataFrame, key_pattern: str | None = None) -> DataFrame:
    """Keys ``(request, pos, key)`` with ``status``; good keys that repeat in the request or exist already say so."""
    first = Window.partitionBy("request", "key").orderBy("pos")
    status = classify_secret(F.col("key"), key_pattern)
    known = existing.select(F.col("key"), F.lit(True).alias("_known")).distinct()
    rows = keys.withColumn("status", status).withColumn("_n", F.row_number().over(first)).join(known, "key", "left")
    status = (F.when(F.col("status") != "ok", F.col("status")).when(F.col("_n") > 1, "duplicate_in_request")
              .when(F.col("_known"), "duplicate_existing").otherwise("ok"))
    return rows.withColumn("status", status).drop("_n", "_known")
