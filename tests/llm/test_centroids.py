"""Centroid clustering against plain integers, one vector after another."""

import hashlib

import duckdb
import numpy as np
import pytest
from loomwork.llm import centroids

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(float(np.float32(x)) * 1024)) for x in e]) for i, e in rows
            if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    start = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    cs = [v for _, v in start]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    at = lambda v: min((far(v, c), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(at(v)[1], []).append(v)
        cs = [[sum(x) // len(g) for x in zip(*g)] if (g := groups.get(n)) else c for n, c in enumerate(cs)]
    out = [(i, *reversed(at(v))) for i, v in kept]
    total = sum(d for *_, d in out)
    return sorted(((i, n, d, sum(y for _, m, y in out if m == n), total, hashlib.sha256(",".join(map(str, cs[n])).encode()).hexdigest()) for i, n, d in out), key=str)


def run(spark, rows, schema=SCHEMA):
    frame = spark.createDataFrame(rows, schema)
    found, cs = centroids.clustered(frame)
    names = [centroids.digest(c) for c in cs]
    return sorted(((*(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia")), names[r["cluster"]]) for r in found.collect()), key=str)


def vectors(n=300, seed=1):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(12, 64))
    return [(i, (middle[i % 12] + 0.3 * rnd.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]


def test_plain(spark):
    odd = [(900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [float("nan")] * 64), (904, [float("inf")] * 64), (None, [0.5] * 64), (5, [0.25] * 64)]
    rows = vectors() + odd + vectors()[:40]
    assert run(spark, rows) == plain(rows)


def test_ties_copies_and_few(spark):
    same = [(i, [0.5] * 64) for i in range(200)] + [(200, [-0.5] * 64)]
    assert run(spark, same) == plain(same)
    few = vectors(3)
    assert run(spark, few) == plain(few)
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == []


def test_clashing_columns(spark):
    rows = [(i, e, 7, "x") for i, e in vectors(20)]
    got = run(spark, rows, SCHEMA + ", cluster int, distance string")
    assert got == plain([r[:2] for r in rows])


@pytest.mark.parametrize("spread", [0, 1, 1000])
def test_annulus_finds_the_nearest(spread):
    rnd = np.random.default_rng(spread)
    x, c = rnd.integers(-spread, spread + 1, (500, 4)), rnd.integers(-spread, spread + 1, (40, 4))
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    number, distance = centroids.nearest(x, c)
    assert (distance == d.min(1)).all() and (number == d.argmin(1)).all()


def test_sql(spark):
    rows = vectors(120)
    con = duckdb.connect()
    con.register("embeddings", spark.createDataFrame(rows, SCHEMA).toArrow())
    cols = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted(con.sql(centroids.ORACLE).select(*cols).fetchall(), key=str) == plain(rows)
