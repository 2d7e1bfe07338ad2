import hashlib
import re

from made_texts import prose
from loomwork.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UP))


def brute(text, items):
    w, hit, held = words(text), set(), set()
    for item, t in items:
        v = words(t)
        k = min(10, len(v))
        windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                held.add(str(item))
    ids = ",".join(sorted(held))
    return len(w), len(hit), len(held), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def check(spark, docs_of, texts, items, **more):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(docs_of(texts), bench, **more).collect()}
    assert got == {i: brute(t, items) for i, t in enumerate(texts)}


ITEMS = [(i, prose(i, 25)) for i in range(8)] + [(2, prose(2, 25)), (10, None), (11, " ... "), (12, prose(3, 25))]
TEXTS = [
    prose(100, 40), prose(101, 20) + " " + prose(1, 25) + " " + prose(102, 9), " ".join(words(prose(4, 25))[5:15]), " ".join(words(prose(4, 25))[5:14]),
    prose(5, 25).upper().replace(" ", ", "), None, "", "--", (prose(6, 25) + " ") * 30, prose(3, 25) + " " + prose(7, 25), "É " + prose(0, 25) + " é", prose(8, 30_000),
]


def test_windows_of_ten(spark, docs_of):
    check(spark, docs_of, TEXTS, ITEMS)


def test_short_items_are_one_window(spark, docs_of):
    check(spark, docs_of, [*TEXTS, "x one y", "one two", "two one two three"], [*ITEMS, (20, "one"), (21, "One, two!"), (22, prose(9, 7))])


def test_beyond_the_set_the_join_gives_the_same(spark, docs_of):
    check(spark, docs_of, TEXTS, ITEMS, set_rows=3)


def test_a_large_benchmark_keeps_candidates_few(spark, docs_of):
    """200,000 windows and an item of one word: only texts that hold a block are scanned, with either join the same."""
    items = [(i, prose(20_000 + i, 509)) for i in range(400)] + [(900, "uniquelyword"), (901, prose(77_777, 3))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [prose(i, 60) for i in range(300)] + [prose(400, 20) + " " + " ".join(words(items[7][1])[100:110]), "one uniquelyword here", prose(77_777, 3) + " x"]
    docs = docs_of(texts)
    windows = decontaminate.benchmark_windows(bench).cache()
    assert windows.count() > 199_000
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())
    _, may = decontaminate.candidates(docs, windows, lengths)
    assert {r[0] for r in may.select("_id").collect()} >= {300, 301, 302} and may.count() < 10
    for set_rows in (decontaminate.SET_ROWS, 1000):
        got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.report(docs, bench, set_rows=set_rows).where("contaminated").collect()}
        assert got == {300: (10, 1), 301: (1, 1), 302: (3, 1)}


def test_clean_keeps_the_rest_and_its_columns(spark, docs_of):
    rows = [(None, prose(1, 25), None, None, "c"), (1, prose(300, 30), "en", "s", "c"), (1, prose(300, 30), "en", "s", "c"), (1, prose(2, 25), "en", "s", "c"), (2, None, "en", "s", "c")]
    docs = docs_of(rows, ", n_hit string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and sorted((r.doc_id, r.text or "") for r in left.collect()) == [(1, prose(300, 30))] * 2 + [(2, "")]
    assert decontaminate.report(docs_of([]), bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
