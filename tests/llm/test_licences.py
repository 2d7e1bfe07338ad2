"""License scans against every block and template, without filters."""

import random
import re

import duckdb
import pytest
from loomwork.llm import licences

TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "words\nReleased under the MIT licence.\nmore", "All rights reserved. ALL RIGHTS\nRESERVED all rights, reserved",
    "cc by cc-by CC BY", "General public license; general Public LICENSE", None, "", " \n\n", "Licensed under CC BY-NC 4.0.", "license mit the under released",
    "released the mit", "naïve 許可 under the", "Ünder CC BY 4.0 licensed",
]
COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def words(text):
    return re.findall(licences.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(doc_id, text):
    w, places, base = words(text), [], set()
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, score = set(base), 0.0
    for line in (text or "").split("\n"):
        own = words(line)
        cut = [own] if len(own) <= licences.BLOCK else [own[i:i + licences.BLOCK] for i in range(0, len(own) - licences.BLOCK // 2, licences.BLOCK // 2)]
        for b in cut:
            pairs = [(len(t & set(b)) / len(t), len(t & set(b)), label) for label, t in ((x, set(t)) for x, t in licences.template_words(licences.TEMPLATES))
                     if 100 * len(t & set(b)) >= licences.LEAST * len(t)]
            labels |= {x for s, n, x in pairs if (s, n) == max(pairs)[:2]}
            score = max([score, *(s for s, *_ in pairs)])
    return (doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else score)


def made(n=150):
    rnd = random.Random(4)
    vocabulary = [w for _, t in licences.template_words(licences.TEMPLATES) for w in t] + ["foo", "bar", "the", "the"]
    out = []
    for _ in range(n):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            own = words(rnd.choice(licences.TEMPLATES)[1])
            kept = [x for x in own if rnd.random() < rnd.choice([0.5, 0.75, 0.95])]
            lines.append(" ".join(kept + rnd.choices(vocabulary, k=rnd.choice([0, 3, 300]))))
        out.append("\n".join(lines))
    return TEXTS + out + TEXTS[:3]


@pytest.fixture
def corpus(docs_of):
    return docs_of([(i % 140, t, "en", "s") for i, t in enumerate(made())])


def test_every_block(spark, corpus):
    got = sorted((tuple(r) for r in licences.report(corpus).select(*COLUMNS).collect()), key=str)
    assert got == sorted((plain(r["doc_id"], r["text"]) for r in corpus.collect()), key=str)


def test_sql(spark, corpus):
    con = duckdb.connect()
    con.register("documents", corpus.toArrow())
    want = sorted(con.sql(licences.ORACLE).select(*COLUMNS).fetchall(), key=str)
    assert sorted((tuple(r) for r in licences.report(corpus).select(*COLUMNS).collect()), key=str) == want


def test_odd_tables(spark, docs_of):
    empty = licences.report(docs_of([]))
    assert empty.count() == 0 and empty.columns == list(COLUMNS)
    clash = spark.createDataFrame([(1, "Released under the MIT License.", "x", 5)], "doc_id long, text string, labels string, w int")
    assert licences.report(clash).first()["labels"] == "mit"
    long = docs_of([(1, "word " * 100_000 + "All rights reserved. " + "word " * 100_000, "en", "s")])
    row = licences.report(long).first()
    assert row["n_words"] == 200_003 and row["first_word"] == 100_000 and row["labels"] == "reserved"


def test_no_template_loses_a_block_at_the_threshold(spark, docs_of):
    four = (("x", "a b c d"),)
    docs = docs_of(["a b c", "d c b", "a b", "c d x y z a"])
    found = {(r["_id"], r["share"]) for r in licences.met(docs, four).collect()}
    assert found == {(0, 0.75), (1, 0.75), (3, 0.75)}
