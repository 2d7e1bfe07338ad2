import math
import re

import pytest
from made_texts import prose
from loomwork.llm import rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORDS.findall(text or "")
    lines, seen, dup = [x for x in (text or "").split("\n") if WORDS.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


@pytest.mark.parametrize("text", [
    None, "", " \n\t", "a", "a a a", "a a a a", "x y z x y z", "l1\nl1\n\nl1 \nl2", "é ü # * $%&|<>  b", "漢 字 漢 字 漢 字", "a\x0bb\x0cc\rd",
    "one two three four one two three five " * 5, "a\n" * 50, "\x1c\x1d a \x85 b",
])
def test_statistics(text):
    assert rules.text_statistics(text) == brute(text)


def test_statistics_of_a_long_text():
    assert rules.text_statistics("word " * 300_000)[4] == 300_000


def test_tail_is_exact():
    for k, n, p in [(0, 10, 0.1), (3, 20, 0.25), (20, 20, 0.5), (5, 400, 0.0025)]:
        assert rules.at_most(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)
    assert rules.at_most(0, 0, 0.1) == 1.0


def corpus(n):
    rows, labels = [], []
    for i in range(n):
        text = prose(i, 80) + (" #" * 3 if i % 400 == 0 else "")
        rows.append((i, text, "en" if i % 3 else "fr", "s"))
        labels.append((i, 1, 0))
    rows += [(n + i, prose(n + i, 80) + " $$$" * 30, "en", "s") for i in range(20)]
    return rows, labels


STATISTIC = {
    "symbols": lambda r: r.n_symbols / r.n_words, "repeats": lambda r: r.n_repeat_words / r.n_words, "lines": lambda r: r.n_dup_lines / r.n_words,
    "long_words": lambda r: r.word_chars / r.n_words}


def by_hand(choosing, testing, good, level):
    """Cutoffs by the definition, document by document: lists of rows to choose the steps by and to test them on."""
    rejected = lambda r, used: any(STATISTIC[k](r) > c for k, c in used.items())
    used, last = {}, {}
    while True:
        steps = []
        for at, (rule, (_, grid)) in enumerate(rules.RULES.items()):
            tighter = [c for c in grid if rule not in used or c < used[rule]]
            if tighter:
                more = used | {rule: tighter[-1]}
                new = [r for r in choosing if rejected(r, more) and not rejected(r, used)]
                kept = sum(r.doc_id in good for r in new)
                steps.append((-(len(new) - kept) / (kept + 1), kept, at, more))
        if not steps:
            return last
        used = min(steps, key=lambda x: x[:3])[3]
        own = [r for r in testing if r.doc_id in good]
        if rules.at_most(sum(rejected(r, used) for r in own), len(own), rules.ALPHA) > level:
            return last
        last = used


def test_cutoffs_are_those_of_the_definition(spark, docs_of):
    rows, labels = corpus(6000)
    rows += [(7000 + i, prose(7000 + i, 80) + " |>" * (i % 40), "de" if i % 2 else None, "s") for i in range(700)]
    labels += [(7000 + i, 1, 0) for i in range(500)] + [(7500 + i, 0, 0) for i in range(200)] + [(6000 + i, 0, i % 2) for i in range(10)]
    good = {i for i, q, t in labels if q and not t}
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    stats = rules.with_statistics(docs_of(rows), ["doc_id", "lang"]).cache()
    got = {}
    for r in rules.cutoffs(stats, known).collect():
        got.setdefault(r.stratum, {})[r.rule] = r.cutoff
    half = {r.doc_id for r in stats.where("pmod(xxhash64('half', doc_id), 2) = 1").collect()}
    held = [r for r in stats.join(known.select("doc_id"), "doc_id").collect() if r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words]
    level = rules.DELTA / 5
    for languages in (["en"], ["fr"], ["de", None]):
        own = [r for r in held if r.lang in languages]
        want = by_hand([r for r in own if r.doc_id not in half], [r for r in own if r.doc_id in half], good, level)
        assert all(got.get(x, {}) == want for x in languages)
    assert got["en"] and got["fr"]
    done = {r.doc_id: r for r in rules.judged(stats, rules.cutoffs(stats, known)).collect()}
    assert not any(done[6000 + i].kept for i in range(20))
    assert sum(not done[i].kept for i in range(6000)) <= 60


def test_small_strata_share_a_pool(spark, docs_of):
    """Four languages with 250 labels each, too few alone: together they certify, and one without labels uses nothing."""
    rows = [(i, prose(i, 60) + (" $$$" * 20 if i % 5 == 0 else ""), "abcd"[i % 4], "s") for i in range(1600)] + [(9000, prose(9000, 60) + " $$$" * 20, "zz", "s")]
    labels = [(i, 0 if i % 5 == 0 else 1, 0) for i in range(1600)]
    stats = rules.with_statistics(docs_of(rows), ["doc_id", "lang"])
    chosen = rules.cutoffs(stats, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).cache()
    assert {r.stratum for r in chosen.collect()} == set("abcd") and chosen.where("rule = 'symbols'").count() == 4
    done = {r.doc_id: r.kept for r in rules.judged(stats, chosen).collect()}
    assert done[9000] and not any(done[i] for i in range(0, 1600, 5)) and sum(done[i] for i in range(1600) if i % 5) >= 1267


def test_few_labels_certify_nothing(spark, docs_of):
    rows, labels = corpus(40)
    stats = rules.with_statistics(docs_of(rows), ["doc_id", "lang"])
    assert rules.cutoffs(stats, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_odd_rows(spark, docs_of):
    rows = [(None, None, None, None, "c"), (1, "", "en", "s", "c"), (1, "", "en", "s", "c"), (2, prose(1, 60), None, "s", "c")]
    stats = rules.with_statistics(docs_of(rows, ", kept string"), ["doc_id", "lang"])
    none = spark.createDataFrame([(2, 1, 0), (2, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id or -1, r.base_failed, r.kept) for r in rules.judged(stats, rules.cutoffs(stats, none)).collect())
    assert got == [(-1, True, False), (1, True, False), (1, True, False), (2, False, True)]
    empty = rules.with_statistics(docs_of([]), ["doc_id", "lang"])
    assert rules.judged(empty, rules.cutoffs(empty, none.limit(0))).count() == 0
