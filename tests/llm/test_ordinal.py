import numpy as np
from made_texts import prose
from loomwork.llm import ordinal


def corpus(n=300):
    docs, labels = [], []
    for i in range(n):
        text, quality, toxic = prose(i, 60), 1, 0
        if i % 3 == 1:
            text, toxic = text + " vile scum", 1
        if i % 3 == 2:
            text, quality = " ".join(w + "%%%" for w in text.split()), 0
        docs.append((i, text, "en", "s"))
        labels.append((i, quality, toxic))
    return docs, labels


def test_held_out_grades(spark, docs_of):
    docs, labels = corpus()
    known = spark.createDataFrame([x for x in labels if x[0] < 200], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in ordinal.graded_documents(docs_of(docs), known, ["doc_id"]).collect()}
    assert len(got) == 300
    right = [got[i].kept == (q == 1 and not t) for i, q, t in labels if i >= 200]
    assert np.mean(right) > 0.95
    mean = {k: np.mean([got[i].expected_grade for i in range(200, 300) if i % 3 == k]) for k in range(3)}
    assert mean[0] > mean[2] > mean[1]


def test_reruns_agree(spark, docs_of):
    docs, labels = corpus(90)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one, two = (sorted(map(tuple, ordinal.graded_documents(docs_of(docs), known, ["doc_id"]).collect())) for _ in range(2))
    assert one == two


def test_thresholds_stay_ordered_and_probabilities_add_up():
    draw = np.random.default_rng(1)
    rows = [np.unique(draw.integers(0, 50, 8)) for _ in range(200)]
    model = ordinal.fit_shard(rows, draw.integers(0, 3, 200), ordinal.OrdinalModel())
    assert np.all(np.diff(model.cuts) >= 0)
    s = np.array([-3.0, 0.0, 3.0])
    assert np.all(np.diff(model.expected(s)) > 0) and np.all((model.below(s) >= 0) & (model.below(s) <= 1))


def test_gradient_is_that_of_the_loss():
    draw = np.random.default_rng(11)
    for _ in range(200):
        first, logs, s, y = draw.normal(0, 2), draw.normal(0, 0.7, 3), draw.normal(0, 2), int(draw.integers(0, 5))

        def at(f, g, x, grade=y):
            return ordinal.loss(f + np.concatenate([[0.0], np.cumsum(np.exp(g))]), x, grade)

        by_score, by_first, by_gaps = ordinal.gradient(first, np.exp(logs), s, y)
        e = 1e-5
        assert abs(by_score - (at(first, logs, s + e) - at(first, logs, s - e)) / (2 * e)) < 1e-4
        assert abs(by_first - (at(first + e, logs, s) - at(first - e, logs, s)) / (2 * e)) < 1e-4
        for k in range(3):
            d = np.eye(3)[k] * e
            assert abs(by_gaps[k] - (at(first, logs + d, s) - at(first, logs - d, s)) / (2 * e)) < 1e-4


def test_few_or_no_ratings_of_a_grade_keep_the_good(spark, docs_of):
    for poor in (0, 1, 3, 10):
        docs, labels = [], []
        for i in range(600):
            toxic = i % 2
            docs.append((i, prose(i, 40) + (" vile scum" if toxic else ""), "en", "s"))
            labels.append((i, 0 if not toxic and i < 2 * poor else 1, toxic))
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        got = {r.doc_id: r.kept for r in ordinal.graded_documents(docs_of(docs), known, ["doc_id"]).collect()}
        assert np.mean([got[i] for i in range(20, 600, 2)]) > 0.95 and np.mean([got[i] for i in range(21, 600, 2)]) < 0.05


def test_the_query_equals_the_model_by_hand(spark, docs_of):
    """Scores of every row against the fitted weights summed text by text with the probabilities written out."""
    docs, labels = corpus(120)
    docs += [(7, "another text of seven", "en", "s"), (500, None, "en", "s"), (501, "", "en", "s")]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = ordinal.fit(docs_of(docs), ordinal.graded(known))
    want = []
    for i, text, *_ in docs:
        s = sum(model.weights[k] for k in set(ordinal.features(text).tolist()))
        below = [1 / (1 + np.exp(s - c)) for c in model.cuts]
        want.append((i, round(sum(1 - b for b in below), 6), round(1 - below[1], 6), 1 - below[1] >= ordinal.TAIL))
    got = [(r.doc_id, round(r.expected_grade, 6), round(r.p_good, 6), r.kept) for r in ordinal.graded_documents(docs_of(docs), known, ["doc_id"]).collect()]
    assert sorted(got) == sorted(want)


def test_without_ratings_all_stay(spark, docs_of):
    docs = docs_of([None, "", "x", "x"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ordinal.select_good(docs, none).count() == 4


def test_odd_rows(spark, docs_of):
    docs, labels = corpus(60)
    odd = [(None, "a b", None, None), (900, None, "en", "s"), (901, "", "en", "s"), (902, "w " * 200_000, "en", "s"), (902, "w " * 200_000, "en", "s")]
    labels = labels + [(None, 1, 0), (3, None, 0), (4, 1, None), (900, 1, 0), (0, 0, 0)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    both = docs_of([(*r, i) for i, r in enumerate(docs + odd)], ", score int")
    rows = ordinal.select_good(both, known)
    assert rows.columns == both.columns
    assert rows.count() <= 65
    assert ordinal.graded_documents(docs_of([]), known, ["doc_id"]).count() == 0


def test_clashing_ratings_count_as_the_worst(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (2, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in ordinal.graded(labels).collect()} == {1: 1, 2: 0, 3: 2}


def test_good_documents_are_chosen_in_light_batches(spark, monkeypatch):
    """The batches' bound holds while the texts go through Python, not only while the stage is set up."""
    docs = spark.createDataFrame([(i, f"words of text {i % 7} " * 9) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    real, before = ordinal.written, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(ordinal, "written", lambda df, name, **more: (seen.append((name, int(spark.conf.get(key)))), real(df, name, **more))[1])
    rows = ordinal.select_good(docs, labels)
    assert ("ordinal-good", 4 << 20) in seen and spark.conf.get(key) == before
    assert set(rows.columns) == {"doc_id", "text"} and rows.count() <= 60
