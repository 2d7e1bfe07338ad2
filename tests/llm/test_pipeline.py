import hashlib
import math
from collections import Counter

import pytest
import test_decontaminate
import test_minmax
import test_mixing
from made_texts import prose

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def folder(spark, docs_of, tmp_path):
    bench = [(i, prose(9000 + i, 25)) for i in range(5)]
    docs, labels = [], []
    for i in range(240):
        text, toxic = prose(i, 60), 0
        if i % 4 == 3:
            text, toxic = text + " vile scum", 1
        docs.append((i, text, "en", f"s{i % 3}"))
        labels.append((i, 1, toxic))
    docs += [(300 + i, docs[i][1] + " end", "en", "s0") for i in range(0, 40, 4)]  # near copies
    docs += [(400, prose(400, 40) + " " + bench[2][1], "en", "s1"), (500, None, "en", None), (501, "", "en", "s2")]
    docs_of(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, folder).cache()
        assert docs.columns[: len(columns)] == columns and (k == 4 or docs.columns == columns)
        ids.append({r.doc_id for r in docs.collect()})
    quality, dedup, leaks, mix, shard = ids
    assert not {i for i in quality if i < 240 and i % 4 == 3} and len({i for i in quality if i < 240}) >= 178
    assert not {i for i in dedup if 300 <= i < 400} and quality - dedup <= set(range(300, 400))
    assert dedup - leaks == {400}
    assert mix <= leaks and shard == mix
    counts = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1


def test_run_gives_the_same_rows_twice(spark, folder):
    one, two = (sorted((str(r.doc_id), r.shard, r.slot) for r in pipeline.run(spark, folder).collect()) for _ in range(2))
    assert one == two and one


def test_the_stages_equal_their_brute_force_versions(spark, folder):
    """From what the classifier keeps on: all pairs, all windows, refilled targets with the drawn copies, and one sorted list."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [pipeline.STAGES[0][1](spark, docs, folder).cache()]
    for _, stage in pipeline.STAGES[1:]:
        kept.append(stage(spark, kept[-1], folder).cache())
    quality, dedup, leaks, mix, shard = ([(r.doc_id, r.text, r.source) for r in x.collect()] for x in kept)

    _, component = test_minmax.brute({i: t for i, t, _ in quality})
    assert sorted(dedup, key=str) == sorted((r for r in quality if component[r[0]] == r[0]), key=str)

    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert sorted(leaks, key=str) == sorted((r for r in dedup if not test_decontaminate.brute(r[1], bench)[1]), key=str)

    sizes = Counter()
    for _, t, source in leaks:
        sizes[source] += len((t or "").split())
    targets, want = test_mixing.fill(dict(sizes)), []
    for r in leaks:
        rate = targets[r[2]] / sizes[r[2]] if sizes[r[2]] else 0.0
        drawn = int(hashlib.md5(f"mix-1:{r[0]}:{len((r[1] or '').encode())}".encode()).hexdigest()[:13], 16) / 2**52
        want += [r] * (math.floor(rate) + (drawn < rate - math.floor(rate)))
    assert sorted(mix, key=str) == sorted(want, key=str)

    # Rows of a source keep one order, so positions follow from the sorted fractions of their ranks.
    placed = sorted(kept[-1].collect(), key=lambda r: (r.shard, r.slot))
    assert sorted(((r.doc_id, r.text, r.source) for r in placed), key=str) == sorted(mix, key=str)
    n, ranks, fractions = Counter(r.source for r in placed), Counter(), []
    for r in placed:
        fractions.append((ranks[r.source] + 0.5) / n[r.source])
        ranks[r.source] += 1
    assert fractions == sorted(fractions)
    assert Counter(r.shard for r in placed) == {k: -(-len(placed) * (k + 1) // 16) - -(-len(placed) * k // 16) for k in range(16)}
