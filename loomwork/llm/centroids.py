"""Centroid clustering of integer vectors, each assigned by annulus search.

Centroids are sorted by their norm. A vector of norm n with an upper bound u on its distance to the nearest centroid can
only be nearest to centroids whose norm lies in [n - u, n + u] (triangle inequality), so a binary search for both ends
gives the candidates, which are compared exactly in integers. The bound is the exact distance to the centroid that is
next in norm; the ends are padded by more than floating point can err and are inclusive, so candidates at the boundary
and ties are compared too. Of equally near centroids the one with the smaller number wins.

The vectors are written once as integers. Each round is one scan: a task adds up the vectors of each cluster and gives
at most k rows, Spark adds those, and the driver holds k centroids only. No vector is shuffled, and a cluster that holds
most vectors costs no more than another.

Cases: vectors that are null, have another number of components, a null or non-finite one, or one beyond ``LIMIT`` (whose
squares a long could not hold) are left out; repeated rows count as often as they stand and get equal rows; a null id is
the empty id in the seeds' hash; fewer vectors than centroids give fewer centroids; centroids without vectors stay; an
empty table gives an empty result; columns but the id and the vector are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import passing, small, table, written

SIZE, K, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Greatest absolute component before scaling.
LIMIT = 2.0**17


def scaled(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)``: the vectors that can be clustered, as integers floor(scale * x)."""
    good = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) <= LIMIT))
    kept = vectors.where(F.coalesce(F.when(F.size("embedding") == size, good), F.lit(False)))
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def seeds(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors with the least hashes of seed and id, in the order of the hashes."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = vectors.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in first], dtype=np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each row."""
    norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
    order = np.argsort(norms, kind="stable")
    norms, sorted_c = norms[order], centroids[order]
    own = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    at = np.clip(np.searchsorted(norms, own), 0, len(norms) - 1)
    distance, number = ((x - sorted_c[at]) ** 2).sum(1), order[at].astype(np.int64)
    pad = 1e-9 * (own + norms[-1] + 1)
    reach = np.sqrt(distance.astype(np.float64)) + pad
    low, high = np.searchsorted(norms, own - reach, "left"), np.searchsorted(norms, own + reach, "right")
    for j in range(len(norms)):
        rows = np.flatnonzero((low <= j) & (j < high) & (at != j))
        if len(rows):
            d = ((x[rows] - sorted_c[j]) ** 2).sum(1)
            better = (d < distance[rows]) | ((d == distance[rows]) & (order[j] < number[rows]))
            distance[rows[better]], number[rows[better]] = d[better], order[j]
    return number, distance


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floors of the means of their vectors."""
    k, size = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = matrix(batch.column("v"), size)
            number, _ = nearest(x, centroids)
            for c in np.unique(number):
                total[c] += x[number == c].sum(0)
            count += np.bincount(number, minlength=k)
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(has, pa.int32()), "n": pa.array(count[has], pa.int64()),
                                          "s": pa.array(list(total[has]), pa.list_(pa.int64()))})

    parts = vectors.select("v").mapInArrow(sums, "cluster int, n long, s array<long>")
    means = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size)))
    after = centroids.copy()
    for r in means.collect():
        after[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
    return after


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(vec_id, cluster, distance)`` of each vector."""
    k, size = centroids.shape
    kind = dict(vectors.dtypes)["vec_id"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = nearest(matrix(batch.column("v"), size), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())],
                                             ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(each, f"vec_id {kind}, cluster int, distance long")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance, cluster_inertia, inertia)`` of the vectors that can be clustered, and the centroids."""
    spark = vectors.sparkSession
    with passing(spark):
        ints = written(scaled(vectors, size), "cluster-vectors")
        centroids = seeds(ints, k, seed)
        if not len(centroids):
            return ints.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (
                ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long")))).limit(0), centroids
        for _ in range(rounds):
            centroids = moved(ints, centroids)
        rows = written(assigned(ints, centroids), "cluster-rows", keep=True)
    by_cluster = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sum(r["cluster_inertia"] for r in by_cluster.collect())
    return rows.join(small(by_cluster), "cluster").withColumn("inertia", F.lit(total).cast("long")), centroids


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = clustered(table(spark, sf_dir, "embeddings"))
    names: Column = F.array(*(F.lit(digest(c)) for c in centroids)) if len(centroids) else F.array().cast("array<string>")
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.get(names, F.col("cluster")).alias("centroid_sha256"))


def _oracle(k: int = K, rounds: int = ROUNDS) -> str:
    """The rounds one after another, each vector held against every centroid."""
    far = f"list_sum(list_transform(range(1, {SIZE + 1}), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))"
    steps = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND abs(x) <= {LIMIT})) = {SIZE}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
  FROM (SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v ORDER BY h, v LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, arg_min(c, [d, c]) AS c, min(d) AS d FROM (SELECT v.rid, c.c, {far} AS d FROM v, c{r} AS c) GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} AS o LEFT JOIN (
    SELECT c, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v FROM (
      SELECT a.c, i, sum(v.v[i]) AS s, count(*) AS n FROM a{r} AS a JOIN v USING (rid), range(1, {SIZE + 1}) AS t(i) GROUP BY a.c, i)
    GROUP BY c) AS m ON o.c = m.c)""")
    return f"""WITH {', '.join(steps)}
SELECT v.vec_id, CAST(a.c AS INT) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM v JOIN a{rounds} AS a USING (rid) JOIN c{rounds} AS c ON a.c = c.c
"""


ORACLE = _oracle()
