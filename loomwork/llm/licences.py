"""License scans as an exact set-similarity join of text blocks with license templates.

A block is a line of a text; a line of more than ``BLOCK`` words is cut into windows of so many words, every half of that,
so all of a text is in blocks of bounded size. A block meets a template if it holds at least ``LEAST`` of the template's
distinct words. The words of all templates are counted over the whole corpus and put in one order, the rarest first.
Three filters leave few blocks to verify, and lose none:

* prefix: a template of m words of which ``need`` must be found shares with each block that it meets one of its first
  m - need + 1 words; only these are joined with, and they are its rarest;
* length: the block holds ``need`` words of the templates at all;
* position: where the first shared word stands at i in the template's order and at j in the block's, no more than
  1 + min(m - i, words of the block - j) can be shared.

A pair is formed by its first shared word only, so it comes up once. The join is broadcast if the table of prefixes is
within a bound of rows, which follows from the templates, and shuffled otherwise; no two texts are ever compared.

A block's label is that of the template of which it holds the greatest share, of equal shares the one with more words; all
of them if that leaves several. ``met`` has all pairs.

The fixed phrases of ``PHRASES`` are found apart, word by word, and stay whatever the templates say. The score is 1 for a
text with such a phrase, else the greatest share of a template that one of its blocks holds, 0 if none reaches ``LEAST``.

Cases: null and empty texts have no words and no labels; repeated rows get equal rows; texts that share an id but differ
are told apart by a hash of the text; blocks at the threshold count; an empty table gives an empty result; columns but the
id and the text are ignored. A notice that is wrapped over several lines is met by those of its lines that reach ``LEAST``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import BROADCAST_ROWS, ascii_lower, light, passing, table, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased, the frequent letters first as Java tries the ranges in turn; and one character between them.
RAW, OTHER = r"[a-z\x{80}-\x{10FFFF}A-Z0-9]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Percent of a template's words that a block must hold, and words of a block.
LEAST, BLOCK = 75, 96
BLOCK_KEY = ("_id", "_key", "_line", "_at")
#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices in their usual wording, with a label each.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Released under the BSD License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("reserved", "All rights reserved."),
    ("no-warranty", "The software is provided as is, without warranty of any kind, express or implied"),
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def template_words(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, list[str]]]:
    """The label and the distinct words of each template that has any."""
    cut = ((label, sorted(set(re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in text))))) for label, text in templates)
    return [(label, w) for label, w in cut if w]


def ordered_vocabulary(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The words by how often the corpus has them, the rarest first and equals by name."""
    known = docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "w string")
    known = F.broadcast(known) if len(vocabulary) <= BROADCAST_ROWS else known
    raw = docs.select(F.explode(F.regexp_extract_all("text", F.lit(RAW), F.lit(0))).alias("raw"))
    # ``lower`` is fast and may fold more than A-Z, so what it meets is compared again.
    counts = raw.join(known, (F.lower("raw") == known["w"]) & (ascii_lower(F.col("raw")) == known["w"])).groupBy("w").count()
    seen = {r["w"]: r["count"] for r in counts.collect()}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def prefixes(templates: list[tuple[str, list[str]]], order: list[str], least: int = LEAST) -> list[tuple]:
    """``(w, i, label, need, t)``: the first words of each template, their place from 1, and the template in that order."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for label, own in templates:
        t = sorted(own, key=rank.__getitem__)
        need = -(-least * len(t) // 100)
        rows += [(w, i + 1, label, need, t) for i, w in enumerate(t[: len(t) - need + 1])]
    return rows


def any_of(phrases: Iterable[Iterable[str]]) -> str:
    """A pattern that a text with one of the phrases of words has, in letters of any case."""
    return rf"(?i)(?:^|{OTHER})(?:{'|'.join(f'{OTHER}+'.join(re.escape(w) for w in p) for p in phrases)})(?:{OTHER}|\z)"


def blocks(docs: DataFrame, held: str, size: int = BLOCK) -> DataFrame:
    """``(_id, _key, _line, _at, b)``: the words of each block of the lines that have the pattern, with its line and its first word there from 1."""
    docs = docs.where(F.col("text").rlike(held))
    lines = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), F.posexplode(F.split("text", "\n")).alias("_line", "line"))
    lines = lines.where(F.col("line").rlike(held))
    lines = lines.select("_id", "_key", "_line", words(F.col("line")).alias("w")).where("size(w) > 0")
    half = size // 2
    starts = f"CASE WHEN size(w) <= {size} THEN array(1) ELSE sequence(1, size(w) - {half}, {half}) END"
    cut = lines.select("_id", "_key", "_line", "w", F.explode(F.expr(starts)).alias("_at"))
    return cut.select(*BLOCK_KEY, F.expr(f"CASE WHEN size(w) <= {size} THEN w ELSE slice(w, _at, {size}) END").alias("b"))


def met(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: int = LEAST, size: int = BLOCK) -> DataFrame:
    """``(_id, _key, _line, _at, label, shared, share)``: every block of every text with every template of which it holds enough."""
    known = template_words(templates)
    order = ordered_vocabulary(docs, sorted({w for _, own in known for w in own}))
    rows = prefixes(known, order, least)
    table_of = docs.sparkSession.createDataFrame(rows, "w string, i int, label string, need int, t array<string>")
    table_of = F.broadcast(table_of) if len(rows) <= BROADCAST_ROWS else table_of
    probe = blocks(docs, any_of({(r[0],) for r in rows}), size)
    probe = probe.select(*BLOCK_KEY, "b", F.explode(F.array_distinct("b")).alias("w")).join(table_of, "w")
    vocabulary = F.array(*(F.lit(w) for w in order))
    probe = probe.withColumn("v", F.array_intersect(vocabulary, "b")).where("size(v) >= need")
    probe = probe.where("1 + least(size(t) - i, size(v) - array_position(v, w)) >= need")
    probe = probe.withColumn("shared", F.array_intersect("t", "b"))
    probe = probe.where("shared[0] = w AND size(shared) >= need")
    return probe.select(*BLOCK_KEY, "label", F.size("shared").alias("shared"), (F.size("shared") / F.size("t")).alias("share"))


def labelled(pairs: DataFrame) -> DataFrame:
    """``(_id, _key, own, share)``: the labels of each text; a block gives that of the template it holds most of, the longer one of equals."""
    best = pairs.groupBy(*BLOCK_KEY).agg(F.max(F.struct("share", "shared")).alias("_best"), F.collect_set(F.struct(F.struct("share", "shared").alias("by"), "label")).alias("_all"))
    best = best.select("_id", "_key", F.col("_best.share").alias("share"), F.explode(F.expr("filter(_all, x -> x.by = _best)")).alias("x"))
    return best.groupBy("_id", "_key").agg(F.collect_set("x.label").alias("own"), F.max("share").alias("share"))


def placed(w: str, phrase: str) -> str:
    """SQL for the places from 0 in the words ``w`` where those of the phrase stand one after another."""
    parts = phrase.split()
    same = " AND ".join(f"{w}[i + {k}] = '{p}'" for k, p in enumerate(parts))
    return f"CASE WHEN size({w}) >= {len(parts)} THEN filter(sequence(0, size({w}) - {len(parts)}), i -> {same}) ELSE cast(array() AS array<int>) END"


def phrased(docs: DataFrame, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """``(doc_id, text_key, n_words, at, base)``: places and labels of the fixed phrases in each text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.regexp_count(text, F.lit(RAW)).cast("long").alias("n_words"),
                       F.when(text.rlike(any_of(p.split() for p in phrases)), words(text)).alias("w"))
    places = {label: F.when(F.col("w").isNotNull(), F.expr(placed("w", p))) for p, label in phrases.items()}
    rows = rows.select("doc_id", "text_key", "n_words", F.array(*(
        F.struct(F.lit(label).alias("label"), F.coalesce(at, F.array().cast("array<int>")).alias("at")) for label, at in places.items())).alias("p"))
    return rows.select("doc_id", "text_key", "n_words", F.flatten(F.transform("p", lambda x: x["at"])).alias("at"),
                       F.transform(F.filter("p", lambda x: F.size(x["at"]) > 0), lambda x: x["label"]).alias("base"))


def report(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, least: int = LEAST, size: int = BLOCK) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each document."""
    docs = docs.select("doc_id", "text")
    with passing(docs.sparkSession):
        found = written(labelled(met(docs, templates, least, size)), "licence-met", keep=True)
    found = light(found, 24 * F.size("own"))
    rows = phrased(docs, phrases)
    rows = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (rows["text_key"] == found["_key"]), "left")
    place = lambda x: x.cast("long")
    both = F.array_union("base", F.coalesce("own", F.array().cast("array<string>")))
    return rows.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), place(F.array_min("at")).alias("first_word"), place(F.array_max("at")).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(F.array_sort(both), ",").alias("labels"),
        F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def op11_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    known = template_words(TEMPLATES)
    listed = ", ".join("({}, '{}', [{}])".format(n, label, ", ".join(f"'{w}'" for w in own)) for n, (label, own) in enumerate(known))
    phrases = "\n  UNION ALL ".join(
        "SELECT rid, '{}' AS label, i FROM (SELECT rid, w, unnest(range(0, len(w) - {})) AS i FROM d WHERE len(w) >= {}) WHERE {}".format(
            label, len(p.split()) - 1, len(p.split()), " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())))
        for p, label in PHRASES.items())
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, text, coalesce(regexp_extract_all({low.format('text')}, '{WORD}'), []) AS w FROM documents),
t(n, label, t) AS (VALUES {listed}),
l AS (
  SELECT rid, k, regexp_extract_all({low.format('lines[k]')}, '{WORD}') AS w
  FROM (SELECT rid, lines, unnest(range(1, len(lines) + 1)) AS k FROM (SELECT rid, string_split(text, chr(10)) AS lines FROM d WHERE text IS NOT NULL))),
b AS (
  SELECT rid, k, 1 AS i, w AS b FROM l WHERE len(w) BETWEEN 1 AND {BLOCK}
  UNION ALL
  SELECT rid, k, i, w[i:i + {BLOCK - 1}] FROM (SELECT rid, k, w, unnest(range(1, len(w) - {BLOCK // 2} + 1, {BLOCK // 2})) AS i FROM l WHERE len(w) > {BLOCK})),
m AS (
  SELECT rid, label, share
  FROM (
    SELECT rid, label, share, rank() OVER (PARTITION BY rid, k, i ORDER BY share DESC, o DESC) AS r
    FROM (
      SELECT rid, k, i, label, o, o / CAST(len(t) AS DOUBLE) AS share
      FROM (SELECT rid, k, i, label, t, len(list_intersect(t, b)) AS o FROM b, t) WHERE 100 * o >= {LEAST} * len(t)))
  WHERE r = 1),
p AS ({phrases}),
pl AS (SELECT rid, count(*) AS n_base, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY rid),
al AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM p UNION ALL SELECT rid, label FROM m) GROUP BY rid),
sh AS (SELECT rid, max(share) AS share FROM m GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pl.n_base, 0) AS BIGINT) AS n_base, CAST(pl.a AS BIGINT) AS first_word,
       CAST(pl.z AS BIGINT) AS last_word, coalesce(pl.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
       CASE WHEN pl.n_base > 0 THEN 1.0 ELSE coalesce(sh.share, 0.0) END AS score
FROM d LEFT JOIN pl USING (rid) LEFT JOIN al USING (rid) LEFT JOIN sh USING (rid)
"""


ORACLE = _oracle()
