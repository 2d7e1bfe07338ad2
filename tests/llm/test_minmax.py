import random
from collections import defaultdict

import numpy as np
from made_texts import prose
from loomwork.llm import minmax


def brute(texts):
    """Sets and components by comparing all pairs."""
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = (t or "").translate(table)
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return sets, {i: top(i) for i in texts}


def changed(text, seed, share):
    draw = random.Random(seed)
    return " ".join("zz" + str(draw.random()) if draw.random() < share else w for w in text.split())


def test_components_equal_all_pairs(spark, docs_of):
    texts = []
    for g in range(25):
        base = prose(g, 120)
        texts += [base, base, changed(base, g, 0.01), changed(base, g + 100, 0.02), changed(base, g + 200, 0.04)]
    shared = prose(999, 40)
    texts += [shared + " " + prose(5000 + i, 80) for i in range(40)]
    texts += [None, "", " \t\n", "a b", "A B", "a b c", "a b c d e", "É é", "é é", "x" * 100_000]
    got = {r.doc_id: r for r in minmax.report(docs_of(texts)).collect()}
    sets, component = brute(dict(enumerate(texts)))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), component[i], component[i] == i) for i in sets}


def test_a_crowd_of_near_copies_is_one_class(spark, docs_of):
    base = prose(1, 200)
    texts = [changed(base, i, 0.01) for i in range(300)]
    _, component = brute(dict(enumerate(texts)))
    got = {r.doc_id: r.component_id for r in minmax.report(docs_of(texts)).collect()}
    assert got == component


def test_a_crowd_of_several_classes_equals_all_pairs(spark, docs_of):
    """Texts that meet in the same buckets though most of them are not linked."""
    base = prose(2, 150)
    texts = [changed(base, i, 0.03) for i in range(60)] + [changed(base, 500 + i % 6, 0.06) + f" {i}" for i in range(60)]
    texts += [prose(7, 60) + " " + prose(i, 60) for i in range(60)] + [prose(7, 60) + " " + prose(i % 5, 12) + " " + prose(i % 7, 9) for i in range(60)]
    _, component = brute(dict(enumerate(texts)))
    assert 20 < len(set(component.values())) < 220
    got = {r.doc_id: r.component_id for r in minmax.report(docs_of(texts)).collect()}
    assert got == component


def test_crossing_finds_each_link_between_components(spark, docs_of, monkeypatch):
    """The joins alone, with every set a component of its own, salted buckets and few rare shingles."""
    monkeypatch.setattr(minmax, "SALT", 7)
    monkeypatch.setattr(minmax, "RARE", 3)
    texts = [changed(prose(i % 4, 80), i, 0.02 * (i % 5)) + " " + prose(50 + i % 3, 10 * (i % 6)) for i in range(80)]
    docs = docs_of(texts)
    rows = minmax.profiles(docs).where("n_shingles > 0")
    sets = rows.selectExpr("doc_id AS id", "n_shingles", "bands", "named_struct('doc_id', doc_id, 'text_key', text_key) AS rep").cache()
    found = minmax.crossing(sets.selectExpr("id", "id AS c", "n_shingles AS n"), sets, docs)[0].collect()
    found = {tuple(sorted((r.a, r.b))) for r in found}
    words = brute(dict(enumerate(texts)))[0]
    links = {(a, b) for a in words for b in words if a < b and words[a] != words[b] and 100 * len(words[a] & words[b]) >= 75 * len(words[a] | words[b])}
    assert len(links) > 40 and links <= found


def test_two_texts_under_one_id(spark, docs_of):
    a, b = prose(41, 40), prose(42, 40)
    rows = lambda *x: [(i, t, "en", "s") for i, t in x]
    docs = docs_of(rows((0, a), (1, a + " tail"), (1, b), (5, b + " end")))
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minmax.report(docs).collect()) == [(0, 0, True), (1, 0, False), (1, 1, True), (5, 1, False)]
    assert sorted((r.doc_id, r.text) for r in minmax.distinct_documents(docs).collect()) == [(0, a), (1, b)]
    docs = docs_of(rows((0, a), (1, a + " tail"), (1, b)))
    assert sorted((r.doc_id, r.component_id) for r in minmax.report(docs).collect()) == [(0, 0), (1, 0), (1, 1)]
    docs = docs_of(rows((3, a), (3, a + " tail"), (2, b)))
    assert sorted(r.doc_id for r in minmax.distinct_documents(docs).collect()) == [2, 3]


def test_one_row_of_each_class_stays(spark, docs_of):
    a, b, c = (prose(60 + i, 40) for i in range(3))
    rows = [(7, a, "en", "s", "k")] * 9 + [(None, b, "en", "s", "k")] * 3 + [(None, b + " end", "en", "s", "k"), (None, c, "en", "s", "k"), (9, c, "en", "s", "k")]
    rows += [(11, "", "en", "s", "k")] * 2 + [(12, "", "en", "s", "k"), (None, None, None, None, "k"), (None, "", None, None, "k"), (None, "", None, None, "k")]
    docs = docs_of(rows, ", _key string")
    got = sorted(((r.doc_id or 0, r.text or "") for r in minmax.distinct_documents(docs).collect()))
    assert len([t for _, t in got if t.startswith(b)]) == 1
    assert [x for x in got if not x[1].startswith(b)] == sorted([(7, a), (9, c), (11, ""), (12, ""), (0, ""), (0, ""), (0, "")])
    assert minmax.distinct_documents(docs).columns == docs.columns


def test_recall_of_links_near_the_threshold(spark, docs_of):
    """Pairs of a similarity from 0.75 to 0.9 alone in their class: none of some 300 may be missed."""
    texts, draw = {}, random.Random(5)
    for g in range(400):
        base = prose(10_000 + g, 100).split()
        near = list(base)
        for k in draw.sample(range(100), draw.randint(1, 3)):
            near[k] = f"zz{g}x{k}"
        texts[2 * g], texts[2 * g + 1] = " ".join(base), " ".join(near)
    sets, component = brute_pairs(texts)
    got = {r.doc_id: r.component_id for r in minmax.report(docs_of([(i, t, "en", "s") for i, t in texts.items()])).collect()}
    assert sum(component[i] != i for i in component) > 250 and got == component


def brute_pairs(texts):
    """Like ``brute`` for texts that are paired as 2 g and 2 g + 1."""
    sets, component = {}, {}
    for g in range(0, len(texts), 2):
        s, c = brute({i: texts[i] for i in (g, g + 1)})
        sets, component = sets | s, component | c
    return sets, component


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 70), (70, 90), (90, 90)], "a long, b long")
    got = {r.id: r.component for r in minmax.components(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {90: 70, 100: 70}


def test_minima_and_maxima_estimate_similarity():
    draw = np.random.default_rng(4)
    values = np.unique(minmax._mixed(draw.integers(0, 2**63, 3000, np.uint64)))
    a, b = np.sort(values[:2000]), np.sort(values[500:2500])
    agree = (minmax.signature(a) == minmax.signature(b)).mean()
    assert abs(agree - 1500 / 2500) < 0.15


def test_odd_rows(spark, docs_of):
    text = prose(3, 30)
    rows = [(None, text, None, None, "k"), (None, text, None, None, "k"), (7, text, "en", "s", "k"), (7, text, "en", "s", "k"), (None, None, None, None, "k"), (8, text + " tail", "en", "s", "k")]
    docs = docs_of(rows, ", component_id string")
    got = sorted((r.doc_id is None, r.component_id, r.kept) for r in minmax.report(docs).collect() if r.n_shingles)
    assert got == [(False, 7, False), (False, 7, True), (False, 7, True), (True, 7, False), (True, 7, False)]
    kept = minmax.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert minmax.report(docs_of([])).count() == 0


def test_links_are_found_both_ways():
    pairs = defaultdict(int)
    for s in range(200):
        base = prose(s, 60)
        near = changed(base, s, 0.03)
        a, b = minmax.shingles(base), minmax.shingles(near)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            x, y = minmax.bands(minmax.signature(a)), minmax.bands(minmax.signature(b))
            pairs[bool((x == y).any())] += 1
    assert pairs[True] > 30 and pairs[False] == 0
