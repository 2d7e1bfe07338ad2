"""Term candidates, glossaries and their use in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import fold, whole_word
from loomwork.operators.scale import small


def term_key(term: Column) -> Column:
    return fold(F.trim(F.regexp_replace(term, r"\s+", " ")))


def merged_candidates(candidates: DataFrame, alternatives: int = 5) -> DataFrame:
    """One row per term of candidates ``(doc, source_term, term_type, target_term, occurrences, confidence, keep_original, alternatives)``.

    Documents, occurrences, mean confidence, targets with the documents that propose them, votes and other proposals;
    ``conflict`` tells that targets differ. The first document gives a term's spelling and type.
    """
    rows = candidates.withColumns({"key": term_key(F.col("source_term")), "target_term": F.trim("target_term")})
    # By document first, then by target, then by term. A document counts for a target once and for a term where its first target is.
    first = F.struct("doc", "source_term", "term_type")
    by_doc = rows.groupBy("key", "target_term", "doc").agg(
        F.min(first).alias("first"), F.sum("occurrences").alias("occurrences"), F.sum("confidence").alias("confidence"),
        F.count("confidence").alias("n"),
        F.count_if("keep_original").alias("keep"), F.count_if(~F.col("keep_original")).alias("translate"),
        F.array_distinct(F.flatten(F.collect_set("alternatives"))).alias("proposed"))
    rank = F.row_number().over(Window.partitionBy("key", "doc").orderBy("target_term"))
    by_doc = by_doc.withColumn("new", F.when(F.col("doc").isNotNull() & (rank == 1), 1).otherwise(0))
    by_target = by_doc.groupBy("key", "target_term").agg(
        F.min("first").alias("first"), F.count("doc").alias("docs"),
        *(F.sum(c).alias(c) for c in ("new", "occurrences", "confidence", "n", "keep", "translate")),
        F.array_distinct(F.flatten(F.collect_set("proposed"))).alias("proposed"))
    variant = F.struct((-F.col("docs")).alias("order"), "target_term", "docs")
    both = by_target.groupBy("key").agg(
        F.min("first").alias("_first"), F.sum("new").alias("docs_count"),
        F.sum("occurrences").alias("occurrences"), F.bround(F.sum("confidence") / F.sum("n"), 3).alias("avg_confidence"),
        F.sum("keep").alias("keep_votes"),
        F.sum("translate").alias("translate_votes"), F.array_distinct(F.flatten(F.collect_set("proposed"))).alias("proposed"),
        F.transform(F.array_sort(F.collect_list(variant)), lambda x: F.struct(x["target_term"].alias("target_term"),
        x["docs"].alias("docs"))).alias("variants"))
    both = both.withColumns({"source_term": F.col("_first.source_term"), "term_type": F.col("_first.term_type")}).drop("_first")
    left = F.array_except("proposed", F.transform("variants", lambda v: v["target_term"]))
    return both.withColumns({"alternatives": F.slice(F.array_sort(left), 1, alternatives), "conflict": F.size("variants") > 1}).drop("proposed")


def review_order(merged: DataFrame) -> DataFrame:
    """Conflicts and low confidence first."""
    return merged.orderBy(F.desc("conflict"), "avg_confidence", F.desc("docs_count"), fold(F.col("source_term")))


def with_evidence(entries: DataFrame, contexts: DataFrame) -> DataFrame:
    """Entries ``(entry, ctx_ids)`` with ``evidence``, the known contexts ``(ctx_id, doc, snippet)`` in the order named."""
    named = entries.select("entry", F.posexplode("ctx_ids").alias("pos", "ctx_id")).join(contexts, "ctx_id")
    found = named.groupBy("entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc", "snippet"))),
                                                   lambda x: F.struct(x["doc"].alias("doc"), x["snippet"].alias("snippet"))).alias("evidence"))
    return entries.join(found, "entry", "left").withColumn("evidence", F.coalesce("evidence", F.array())).drop("ctx_ids")


def _head(term: Column) -> Column:
    return F.regexp_extract(fold(term), r"([\p{L}\p{N}_]+)", 1)


def _met(texts: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """``(key, source_term)`` of entries one of whose heads ``(source_term, _head)`` is a word of the text.

    Only keys and single words leave a text, so the work follows the words that do occur, and no text moves.
    """
    words = F.array_distinct(F.regexp_extract_all(fold(F.col("text")), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    return texts.select(key, F.explode(words).alias("_head")).join(small(heads.distinct()), "_head").select(key, "source_term").distinct()


def _flag(case_sensitive: Column) -> Column:
    return F.when(F.coalesce(case_sensitive, F.lit(False)), "").otherwise("(?iu)")


def terms_in(texts: DataFrame, entries: DataFrame, key: str, plural: bool = True) -> DataFrame:
    """``(key, source_term)`` of entries that occur in texts as whole words.

    A text and an entry meet by the entry's first word before the pattern is tried; a text is then joined once, with the
    list of the entries that it met.
    """
    first = _head(F.col("source_term"))
    one_word = ~fold(F.col("source_term")).rlike(r"[^\p{L}\p{N}_]")
    ends = F.when(one_word & F.lit(plural), F.array(first, F.concat(first, F.lit("s")), F.concat(first, F.lit("es")))).otherwise(F.array(first))
    pairs = _met(texts, entries.select("source_term", F.explode(ends).alias("_head")), key)
    terms = pairs.join(small(entries.select("source_term", "case_sensitive")), "source_term")
    terms = terms.groupBy(key).agg(F.collect_set(F.struct("source_term",
        F.coalesce("case_sensitive", F.lit(False)).alias("case_sensitive"))).alias("_terms"))
    found = F.filter("_terms", lambda t: F.regexp_like(F.col("text"), F.concat(_flag(t["case_sensitive"]), whole_word(t["source_term"], plural))))
    return texts.select(key, "text").join(terms, key).select(key,
        F.explode(F.transform(found, lambda t: t["source_term"])).alias("source_term")).distinct()


def lint(texts: DataFrame, entries: DataFrame, key: str, first_use: DataFrame | None = None) -> DataFrame:
    """``(key, kind, source_term)`` of a glossary's rules that texts break.

    Entries: ``(source_term, target_term, keep_original, case_sensitive, forbidden_variants)``. Forbidden variants; terms
    to be introduced as ``target (source)`` where ``first_use`` ``(key, source_term)`` says; source terms left bare. Each
    of them shows a word of the entry in the text, so texts meet entries by these words and are joined once.
    """
    named = F.array_union(F.array("source_term", "target_term"), F.coalesce("forbidden_variants", F.array().cast("array<string>")))
    pairs = _met(texts, entries.select("source_term", F.explode(F.transform(named, _head)).alias("_head")), key)
    entry = F.struct("source_term", "target_term", "keep_original", "case_sensitive", "forbidden_variants")
    pairs = pairs.join(small(entries.select("source_term", entry.alias("e"))), "source_term")
    if first_use is not None:
        pairs = pairs.join(first_use.select(key, "source_term", F.lit(True).alias("_first")).distinct(), [key, "source_term"], "left")
    else:
        pairs = pairs.withColumn("_first", F.lit(None).cast("boolean"))
    terms = pairs.groupBy(key).agg(F.collect_list(F.struct("e.*", F.coalesce("_first", F.lit(False)).alias("first"))).alias("_terms"))
    text, literal = F.col("text"), lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))

    def broken(t: Column) -> Column:
        has = lambda where, pattern: F.regexp_like(where, F.concat(_flag(t["case_sensitive"]), pattern))
        pair = F.concat(literal(t["target_term"]), F.lit(r"\s*\(\s*"), literal(t["source_term"]), F.lit(r"\s*\)"))
        bare = F.regexp_replace(text, F.concat(_flag(t["case_sensitive"]), pair), F.lit(" "))
        kinds = {
            "forbidden_variant": F.exists(t["forbidden_variants"], lambda v: has(text, whole_word(v))),
            "missing_original_on_first_use": t["keep_original"] & t["first"] & has(text, whole_word(t["target_term"])) & ~has(text, pair),
            "untranslated_source_term": (fold(t["source_term"]) != fold(t["target_term"])) & has(bare, whole_word(t["source_term"]))}
        found = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items())), lambda k: k.isNotNull())
        return F.transform(found, lambda k: F.struct(t["source_term"].alias("source_term"), k.alias("kind")))

    rows = texts.select(key, "text").join(terms, key)
    return rows.select(key, F.inline(F.flatten(F.transform("_terms", broken)))).select(key, "source_term", "kind")


def first_uses(uses: DataFrame, entries: DataFrame) -> DataFrame:
    """``(source_term, section)``: the first section, by ``pos``, of uses ``(section, pos, source_term)`` of kept terms."""
    kept = entries.where("keep_original").select("source_term")
    return uses.join(kept, "source_term", "left_semi").groupBy("source_term").agg(F.min_by("section", "pos").alias("section"))


def effective(*ranked: tuple[DataFrame, int]) -> DataFrame:
    """The entry of the highest priority for each term, whatever its case."""
    rows = None
    for entries, priority in ranked:
        part = entries.withColumn("priority", F.lit(priority))
        rows = part if rows is None else rows.unionByName(part)
    best = Window.partitionBy(F.lower("source_term")).orderBy(F.desc("priority"), "source_term")
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def release(entries: DataFrame) -> DataFrame:
    """A glossary's confirmed entries as one immutable row: ``glossary, entry_count, entries, content_sha256``."""
    line = F.struct(F.lower("source_term").alias("order"), F.to_json(F.struct("source_term", "target_term", "keep_original")).alias("json"))
    rows = entries.where("status = 'confirmed'").groupBy("glossary").agg(F.transform(F.array_sort(F.collect_list(line)),
        lambda x: x["json"]).alias("entries"))
    return rows.select("glossary", F.size("entries").alias("entry_count"), "entries",
        F.sha2(F.array_join("entries", "\n").cast("binary"), 256).alias("content_sha256"))


def next_release(entries: DataFrame, releases: DataFrame) -> DataFrame:
    """``release`` with the ``version`` after the greatest of the glossary's ``(glossary, version, content_sha256)``, and whether
    anything ``changed`` since that one."""
    last = releases.groupBy("glossary").agg(F.max(F.struct("version", "content_sha256")).alias("_last"))
    rows = release(entries).join(last, "glossary", "left")
    changed = ~F.col("content_sha256").eqNullSafe(F.col("_last.content_sha256"))
    return rows.withColumns({"version": F.coalesce("_last.version", F.lit(0)) + 1, "changed": changed}).drop("_last")
