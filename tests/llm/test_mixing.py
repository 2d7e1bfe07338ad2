import math
from collections import defaultdict

from made_texts import prose
from loomwork.llm import mixing
from pyspark.sql import functions as F


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing out again and again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 50, "d": 7, None: 33}, {"a": 5}, {"a": 0, "b": 0}, {"a": 1, "b": 0, "é": 900, "z": 3}):
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = fill(sizes)
        assert all(math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.rate <= 3 for r in got) and len(got) == len(sizes)


def test_taken_follows_the_targets(spark, docs_of):
    docs = docs_of([(i, prose(i, 20 + i % 30), "en", f"s{i % 7 if i % 3 else 0}") for i in range(4000)])
    rows = mixing.with_copies(mixing.measured(docs), seed="t").collect()
    by, target = defaultdict(int), {}
    for r in rows:
        by[r.source] += r.size * r.copies
        target[r.source] = r.target
        assert 0 <= r.copies <= 3 and math.floor(r.target / r.source_size) <= r.copies <= math.ceil(r.target / r.source_size)
    assert all(abs(by[s] / target[s] - 1) < 0.15 for s in by)
    again = mixing.with_copies(mixing.measured(docs), seed="t").collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in again)


def test_chance_is_even(spark):
    draws = [r[0] for r in spark.range(4000).select(mixing.chance(F.col("id"))).collect()]
    assert all(0 <= d < 1 for d in draws) and abs(sum(draws) / 4000 - 0.5) < 0.03


def test_mix_repeats_rows_and_keeps_columns(spark, docs_of):
    rows = [(1, "a b c", "en", "x", 1), (1, "a b c", "en", "x", 1), (None, "q", None, None, 2), (3, None, "en", "y", 3), (4, "", "en", "y", 4), (5, "w " * 100_000, "en", "z", 5)]
    docs = docs_of(rows, ", size int")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert n[1] % 2 == 0 and all(v <= 6 for v in n.values())
    assert mixing.mix(docs_of([])).count() == 0
