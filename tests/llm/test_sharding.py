from collections import Counter, defaultdict

import duckdb
import pytest
from loomwork.llm import sharding


@pytest.mark.parametrize(("rows", "bucket"), [(1000, 20_000), (3000, 100), (5, 20_000), (16, 2)])
def test_counts_order_and_mixture(spark, docs_of, monkeypatch, rows, bucket):
    monkeypatch.setattr(sharding, "ROWS", bucket)
    docs = docs_of([(i, f"t{i}", "en", None if i % 11 == 0 else f"s{i % 5 if i % 3 else 0}") for i in range(rows)])
    got = sharding.interleaved(docs, 16).collect()
    assert sorted(r.doc_id for r in got) == list(range(rows))
    count = Counter(r.shard for r in got)
    assert max(count.values()) - min(count.get(s, 0) for s in range(16)) <= 1
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    n, rank = Counter(r.source for r in got), defaultdict(int)
    last = -1.0
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        f = (rank[r.source] + 0.5) / n[r.source]  # rows of a source keep their shuffled order, so this is the rank
        rank[r.source] += 1
        assert f >= last
        last = f
    for s in count:
        mine = Counter(r.source for r in got if r.shard == s)
        assert all(abs(mine[x] - n[x] / 16) <= 2 for x in n)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, sharding.interleaved(docs.repartition(7), 16).collect()), key=str)


def test_the_shuffle_is_not_the_order_of_ids(spark, docs_of):
    got = sorted(sharding.interleaved(docs_of([(i, "x", "en", "s") for i in range(200)]), 4).collect(), key=lambda r: (r.shard, r.slot))
    assert sum(a.doc_id < b.doc_id for a, b in zip(got, got[1:], strict=False)) < 150


def test_odd_rows(spark, docs_of):
    rows = [(1, "a", "en", "x", "c")] * 5 + [(None, None, None, None, "c")] * 5 + [(2, "", "en", "", "c"), (3, "y" * 1_000_000, "en", "x", "c")]
    docs = docs_of(rows, ", shard string")
    out = sharding.interleaved(docs)
    assert out.count() == 12 and out.columns == [*docs.drop("shard").columns, "shard", "slot"]
    assert sharding.interleaved(docs_of([])).count() == 0


@pytest.mark.parametrize("bucket", [20_000, 40])
def test_sql(spark, docs_of, monkeypatch, tmp_path, bucket):
    monkeypatch.setattr(sharding, "ROWS", bucket)
    texts = ["", None, "a", "é 漢字", "x" * 5000]
    rows = [(None if i % 97 == 5 else i % 500, texts[i % 5] if i % 7 else f"t{i}", "en", None if i % 11 == 0 else "ßz"[i % 2] if i % 3 else "hot") for i in range(700)]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op9_shard_interleave(spark, str(tmp_path))
    cols = sorted(got.columns)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, got.select(cols).collect()))) == sorted(map(str, con.sql(sharding.ORACLE).select(*cols).fetchall()))
