"""Information-theoretic sanitisation: personal data, and the terms whose company gives it away.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers and the secrets (keys and tokens) that
fixed patterns find, and the classes that they belong to: an address's host or network, and the kind. How much a term t
tells of an entity e is estimated from the corpus: the pointwise mutual information
log(N df(e,t) / (df(e) df(t))) over the information of the entity log(N / df(e)). The ratio is 1 if every document with
t has e too. Here N counts documents, df those with the entity, with the term, and with both, wherever they stand; in a
text with e, only terms outside all protected spans are its company. There, terms that reach ``REMOVE`` are removed and
those from ``GENERALISE`` on are generalised to their kind, as long as at least ``SUPPORT`` different texts bear the
estimate out: one text alone, or its copies, cannot tell company from chance. Terms are runs of letters and digits of
three or more, and runs of two CJK characters; CJK text without spaces is not cut into words.

All of it is built-in DataFrame functions. Matches are placed by the lengths of the pieces between them. Patterns are
written so that Java's matcher neither recurses nor scans a run of characters again from each of its places. Pairs of
entity and term are formed in the texts that hold an entity with enough support, each distinct term once; all counts are
combined before they are shuffled. Texts without entities leave the flow after one pass.

Cases: null and empty texts have no spans; repeated rows get equal spans; texts that share an id but differ are told
apart by a hash of the text; an empty table gives an empty result; further columns are ignored by the report and kept
by ``sanitised``; of overlapping spans of different kinds all are reported, and the text loses their union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import light, passing, small, table, written

KINDS = ("email", "ip", "card", "phone")
#: Those, and runs of letters and digits that are too long to be words: keys and tokens.
PROTECTED = (*KINDS, "secret")
#: As the contract has them, with lookbehinds that only save attempts that cannot differ, and possessive tails.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{32,}+",
}
#: What a text must hold to be worth a kind's pattern.
HINTS = {"email": "text LIKE '%@%.%'", "ip": r"text RLIKE '[0-9]\\.[0-9]'", "card": "text RLIKE '[0-9][ -]?[0-9]'", "phone": "text RLIKE '\\\\+[0-9]'",
         "secret": "text RLIKE '[A-Za-z0-9]{32}'"}
_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
#: Marks go with their letter, so a decomposed or Indic word is one term.
TERM = rf"[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]{{2,}}+|{_CJK}{{2}}(?![\p{{L}}\p{{N}}\p{{M}}])"
#: Whole terms of a text whose spans are cut to a NUL each; what touches a span is part of a term that overlaps it.
OUTSIDE = rf"(?<![\x00\p{{L}}\p{{N}}\p{{M}}])(?:{TERM})(?!\x00)"
SUPPORT = 3
REMOVE, GENERALISE = 0.9, 0.7
_SPANS = "array<struct<start:int,end:int,value:string>>"

_DIGITS = "regexp_replace(x, '[^0-9]', '')"
#: From the right, digits at even places count twice, less 9 if above 9.
_LUHN = (f"aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + CASE WHEN (length({_DIGITS}) - i) % 2 = 0 "
         f"THEN int(substring({_DIGITS}, i, 1)) ELSE int(substring('0246813579', int(substring({_DIGITS}, i, 1)) + 1, 1)) END) % 10 = 0")
VALID = {
    "email": "true",
    "ip": "x RLIKE '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.]0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$'",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 16 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
    "secret": "true",
}


#: Matches that one fold takes; a text with more is folded block by block, as a list is copied when it grows.
FOLD = 256


def folded(items: str, begin: str, kind: str, step: str, size: int = FOLD) -> str:
    """SQL of a fold over a list: the state's ``at`` and ``out``, to which the step appends, from block to block in linear time.

    ``step`` tells the next state from the state ``a`` and an item ``z``; the result has ``at`` and ``out`` as one list.
    """
    none = f"cast(array() AS array<{kind}>)"
    within = f"aggregate(c, named_struct('at', o.at, 'out', {none}), (a, z) -> {step})"
    blocks = f"transform(CASE WHEN size({items}) > 0 THEN sequence(0, (size({items}) - 1) div {size}) ELSE cast(array() AS array<int>) END, k -> slice({items}, k * {size} + 1, {size}))"
    once = f"element_at(transform(array({within}), r -> named_struct('at', r.at, 'out', array_append(o.out, r.out))), 1)"
    whole = f"aggregate({blocks}, named_struct('at', {begin}, 'out', cast(array() AS array<array<{kind}>>)), (o, c) -> {once})"
    return f"element_at(transform(array({whole}), w -> named_struct('at', w.at, 'out', flatten(w.out))), 1)"


def placed(text: str, pattern: str, valid: str) -> Column:
    """Spans of the pattern's matches that are valid (``x`` is the match), in order; code points, end exclusive."""
    quoted = "r'" + pattern + "'"
    pieces = f"zip_with(regexp_extract_all({text}, {quoted}, 0), split({text}, {quoted}, -1), (m, s) -> named_struct('m', m, 's', s))"
    step = (f"named_struct('at', a.at + length(z.s) + coalesce(length(z.m), 0), 'out', CASE WHEN z.m IS NOT NULL AND {_on(valid)} THEN array_append(a.out, "
            f"named_struct('start', a.at + length(z.s), 'end', a.at + length(z.s) + length(z.m), 'value', z.m)) ELSE a.out END)")
    fold = folded("ps", "0", "struct<start:int,end:int,value:string>", step)
    return F.expr(f"element_at(transform(array({pieces}), ps -> {fold}.out), 1)")


def _on(valid: str) -> str:
    """The condition with the match for its ``x``."""
    return f"element_at(transform(array(z.m), x -> {valid}), 1)"


def found(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key``, spans by kind, and the text of those that have any."""
    none = F.lit(None).cast(_SPANS)
    spans = {k: F.coalesce(F.when(F.expr(HINTS[k]), placed("text", PATTERNS[k], VALID[k])).otherwise(none), F.array().cast(_SPANS)) for k in PROTECTED}
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"), *(s.alias(k) for k, s in spans.items()))
    some = F.greatest(*(F.size(k) for k in PROTECTED)) > 0
    return written(rows.withColumn("text", F.when(some, F.col("text"))), "pii-found")


def mentions(rows: DataFrame) -> DataFrame:
    """``(text_key, entity)``: the entities of each distinct text, one by one and by their classes.

    A class is the host of an e-mail address, the first three parts of an IP address, or the kind itself: a term may give
    away whose address it is, where it belongs, or that there is one.
    """
    each = "concat(" + ", ".join(f"transform({k}, x -> named_struct('kind', '{k}', 'value', x.value))" for k in PROTECTED) + ")"
    rows = rows.where("text IS NOT NULL").select("text_key", F.explode(F.expr(each)).alias("m"))
    value = "CASE WHEN m.kind = 'email' THEN lower(m.value) WHEN m.kind IN ('ip', 'secret') THEN m.value ELSE regexp_replace(m.value, '[^0-9]', '') END"
    wider = ("CASE WHEN m.kind = 'email' THEN concat('host:', substring_index(lower(m.value), '@', -1)) "
             "WHEN m.kind = 'ip' THEN concat('net:', substring_index(m.value, '.', 3)) END")
    named = f"filter(array(concat(m.kind, ':', {value}), {wider}, concat('kind:', m.kind)), x -> x IS NOT NULL)"
    return rows.select("text_key", F.explode(F.expr(named)).alias("entity")).distinct()


def outside() -> Column:
    """The distinct terms of the text, lower-cased, that overlap no span."""
    spans = "array_sort(concat(" + ", ".join(f"transform({k}, x -> named_struct('s', x.start, 'e', x.end))" for k in PROTECTED) + "))"
    pieces = cut("translate(text, chr(0), ' ')", spans, "chr(0)")
    return F.expr(f"array_distinct(transform(regexp_extract_all({pieces}, r'{OUTSIDE}', 0), t -> lower(t)))")


def cut(text: str, spans: str, by: str) -> str:
    """SQL of the text with each of the sorted spans ``(s, e, ..)``, or what overlapping ones cover, put by ``by`` of the span ``z``.

    Characters of a text are found from its start, so one with many spans is taken apart into them first.
    """
    step = ("CASE WHEN z.e <= a.at THEN a ELSE named_struct('at', z.e, 'out', concat(a.out, array({part}, CASE WHEN z.s >= a.at THEN " + by + " ELSE '' END))) END")
    few = "substring(tx, a.at + 1, greatest(0, z.s - a.at))"
    many = "CASE WHEN z.s > a.at THEN array_join(slice(ch, a.at + 1, z.s - a.at), '') ELSE '' END"
    end = {"few": "substring(tx, w.at + 1)", "many": "CASE WHEN w.at < size(ch) THEN array_join(slice(ch, w.at + 1, size(ch) - w.at), '') ELSE '' END"}
    whole = {k: f"element_at(transform(array({folded('sp', '0', 'string', step.format(part=part))}), w -> concat(array_join(w.out, ''), {end[k]})), 1)"
             for k, part in (("few", few), ("many", many))}
    apart = f"element_at(transform(array(split(tx, '')), ch -> {whole['many']}), 1)"
    return f"element_at(transform(array({spans}), sp -> element_at(transform(array({text}), tx -> CASE WHEN size(sp) <= {FOLD} THEN {whole['few']} ELSE {apart} END), 1)), 1)"


def company(rows: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``(text_key, times, entities, terms)`` of the distinct texts with entities of enough support; entities with their ``df_e``."""
    times = rows.where("text IS NOT NULL").groupBy("text_key").agg(F.count("*").alias("times"))
    seen = written(mentions(rows).join(times, "text_key"), "pii-mentions")
    entities = seen.groupBy("entity").agg(F.count("*").alias("n"), F.sum("times").alias("df_e")).where(F.col("n") >= support).drop("n")
    held = seen.join(small(written(entities, "pii-entities")), "entity").groupBy("text_key")
    held = held.agg(F.first("times").alias("times"), F.collect_list(F.struct("entity", "df_e")).alias("entities"))
    held = light(written(held, "pii-held"), F.lit(64) * F.size("entities"))
    texts = rows.where("text IS NOT NULL").join(held, "text_key").dropDuplicates(["text_key"])
    return written(texts.select("text_key", "times", "entities", outside().alias("terms")), "pii-company")


def paired(together: DataFrame) -> DataFrame:
    """``(text_key, times, entity, df_e, term)``: each entity of a text with each of the text's terms."""
    each = together.select("text_key", "times", F.explode("entities").alias("e"), "terms")
    return each.select("text_key", "times", "e.entity", "e.df_e", F.explode("terms").alias("term"))


def disclosing(docs: DataFrame, rows: DataFrame, support: int = SUPPORT, least: float = GENERALISE, together: DataFrame | None = None) -> DataFrame:
    """``(entity, term, disclosure)`` of the pairs that reach the least disclosure with enough support.

    How many documents have a term is summed over all terms before anything is joined: what is shuffled is the
    vocabulary, and the join meets one row per term.
    """
    pairs = paired(company(rows, support) if together is None else together).groupBy("entity", "term")
    pairs = pairs.agg(F.count("*").alias("n"), F.sum("times").alias("df_et"), F.first("df_e").alias("df_e")).where(F.col("n") >= support).drop("n")
    pairs = written(pairs, "pii-pairs")
    words = F.expr(f"array_distinct(transform(regexp_extract_all(text, r'{TERM}', 0), t -> lower(t)))")
    df_t = docs.where("text IS NOT NULL").select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("df_t"))
    total = float(max(rows.count(), 2))
    info = F.log(F.lit(total) / F.col("df_e"))
    pmi = F.log(F.lit(total) * F.col("df_et") / (F.col("df_e") * F.col("df_t")))
    disclosure = F.when(info > 0, pmi / info).otherwise(F.lit(0.0))
    return df_t.join(small(pairs), "term").select("entity", "term", disclosure.alias("disclosure")).where(F.col("disclosure") >= least)


def spans_of(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``doc_id, text_key``, spans by kind, and ``term``: the spans of disclosing terms with their disclosure."""
    rows = found(docs)
    together = company(rows, support)
    telling = written(disclosing(docs, rows, support, together=together), "pii-telling")
    texts = rows.where("text IS NOT NULL").dropDuplicates(["text_key"])
    flagged = paired(together).join(small(telling), ["entity", "term"]).groupBy("text_key", "term").agg(F.max("disclosure").alias("d"))
    flagged = flagged.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("terms"))
    texts = texts.join(flagged, "text_key").select("text_key", "text", "terms", *PROTECTED)
    base = "concat(" + ", ".join(f"transform({k}, b -> named_struct('s', b.start, 'e', b.end))" for k in PROTECTED) + ")"
    at = texts.select("text_key", F.expr(base).alias("base"), "terms", placed("text", TERM, "terms[lower(x)] IS NOT NULL").alias("term"))
    free = "filter(term, x -> NOT exists(base, b -> x.start < b.e AND b.s < x.end))"
    shaped = f"transform({free}, x -> named_struct('start', x.start, 'end', x.end, 'value', x.value, 'disclosure', terms[lower(x.value)]))"
    at = light(written(at.select(F.col("text_key").alias("_key"), F.expr(shaped).alias("term")), "pii-terms"), F.lit(48) * F.size("term"))
    none = F.array().cast("array<struct<start:int,end:int,value:string,disclosure:double>>")
    return rows.drop("text").join(at, rows["text_key"] == at["_key"], "left").drop("_key").withColumn("term", F.coalesce("term", none))


def listed(*kinds: str) -> Column:
    parts = ", ".join(f"transform({k}, x -> concat('{k}:', x.start, ':', x.end))" for k in kinds)
    return F.expr(f"array_join(concat({parts}), ',')")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts by kind, the digest of the fixed kinds' spans, all spans, and counts of secrets and terms."""
    with passing(docs.sparkSession):
        rows = spans_of(docs).select(
            "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
            F.sha2(listed(*KINDS).cast("binary"), 256).alias("base_sha256"), listed(*PROTECTED, "term").alias("spans"),
            F.size("secret").cast("long").alias("n_secret"), F.size("term").cast("long").alias("n_term"))
        return written(rows, "pii-report", keep=True)


def sanitised(docs: DataFrame) -> DataFrame:
    """The documents with entities as ``[KIND]``, removed terms gone and generalised ones as ``[TERM]``."""
    parts = [f"transform({k}, x -> named_struct('s', x.start, 'e', x.end, 'by', '[{k.upper()}]'))" for k in PROTECTED]
    parts.append(f"transform(term, x -> named_struct('s', x.start, 'e', x.end, 'by', CASE WHEN x.disclosure >= {REMOVE} THEN '' ELSE '[TERM]' END))")
    with passing(docs.sparkSession):
        spans = spans_of(docs).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.expr(f"array_sort(concat({', '.join(parts)}))").alias("_cuts"))
        spans = written(spans.where(F.size("_cuts") > 0).dropDuplicates(["_id", "_key"]), "pii-cuts", keep=True)
    packed = docs.select("doc_id", F.xxhash64("text").alias("_key_of"), "text", F.struct(*docs.columns).alias("row"))
    both = packed.join(spans, packed["doc_id"].eqNullSafe(spans["_id"]) & (packed["_key_of"] == spans["_key"]), "left")
    text = F.when(F.col("_cuts").isNotNull(), F.expr(cut("text", "_cuts", "z.by"))).otherwise(F.col("text"))
    return both.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def op6_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
